"""winnowry: document fingerprinting and similarity joins as DataFrame plans."""

from .params import Params

__all__ = ["Params"]
