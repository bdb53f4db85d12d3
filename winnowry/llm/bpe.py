"""Operator 9, BPE encoding and decoding with one trie of distinct words.

BPE has this property: the encoding of a prefix ends in exactly one token, and
that token depends on the prefix alone.  It is the suffix token t for which the
encoding of what stands before ends in a token s so that no merge crosses the
border of s and t.  So the words of a chunk of texts are put into a trie, walked
depth first with a stack of last tokens; a prefix that many words share is
worked out once.  The sorted list of words is that trie in depth-first order:
the common prefix of neighbours is the part of the stack that stays.

Defined results: null texts are as empty ones, with no ids and an empty decoded
text; rows are kept one for one, repeated ones too; an empty table gives an empty
result; other columns are returned as they are; special strings
inside texts become their special tokens, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, release
from .common import table

#: Characters that normalization leaves alone but for lower case, with the same class in every Unicode version.
STABLE = r"[\t\n\r\x20-\x7e¡-¬®-įı-ƿ‐-‧‰-⁞€]*+"
#: Most words, runs between white space and pairs of tokens a worker remembers of each; beyond it that memory starts anew, which only repeats work.
REMEMBERED = 200_000
#: Bytes of text worked on at once; nothing is shuffled, so small blocks cost nothing.
BLOCK = 2 << 20
INF = 1 << 60


class TrieEncoder:
    """Encodes sets of words; a word is a sequence of symbols, the last one closed by ``end``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        #: by the last three symbols of a token: the lengths that longer tokens with that end have, falling
        ends: dict[str, set] = {}
        for t in vocab:
            body = t[: -len(end)] if end and t.endswith(end) else t
            if len(body) > 2:
                ends.setdefault(body[-3:] + t[len(body) :], set()).add(len(body))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.text = {i: t for t, i in vocab.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        #: whether merging a token's symbols gives the token (2: not asked yet)
        self.reachable = dict.fromkeys(vocab, 2)
        self.spines: dict[str, tuple | None] = {}

    def symbols(self, token: str) -> list[str]:
        e = self.end
        if e and token.endswith(e):
            body = token[: -len(e)]
            return [*body[:-1], body[-1:] + e]
        return list(token)

    def spine(self, token: str):
        """((left edge), (right edge)) of the token's merge tree, each (part, rank that made it) from leaf to root; None if merging its symbols does not give the token."""
        if token not in self.spines:
            parts = [(s, -1, ((s, -1),), ((s, -1),)) for s in self.symbols(token)]
            while len(parts) > 1:
                best, at = min((self.rank.get((a[0], b[0]), INF), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == INF:
                    break
                a, b = parts[at : at + 2]
                whole = a[0] + b[0]
                parts[at : at + 2] = [(whole, best, (*a[2], (whole, best)), (*b[3], (whole, best)))]
            self.spines[token] = parts[0][2:] if len(parts) == 1 else None
        return self.spines[token]

    def stand(self, s: str, t: str) -> bool:
        """True if the merges of s followed by t never cross their border."""
        left, right = self.spine(s)[1], self.spine(t)[0]
        i = j = 0
        while True:
            ahead_l = left[i + 1][1] if i + 1 < len(left) else INF
            ahead_r = right[j + 1][1] if j + 1 < len(right) else INF
            across = self.rank.get((left[i][0], right[j][0]), INF)
            if across < ahead_l and across <= ahead_r and across < INF:
                return False
            if ahead_l == INF and ahead_r == INF:
                return True
            if ahead_l <= ahead_r:
                i += 1
            else:
                j += 1

    def _last(self, word: str, d: int, closing: str, stack: list) -> tuple[str, int]:
        """The last token of word[:d] + closing, and its length in symbols."""
        reachable, fits = self.reachable, self.fits
        if closing:
            word = word[:d] + closing
            d, shift = len(word), len(closing)
        else:
            shift = 0
        inner = d - shift
        for length in self.lengths.get(word[inner - 3 : d], (2, 1)) if inner > 2 else range(inner, 0, -1):
            if length > inner:
                continue
            t = word[inner - length : d]
            if (known := reachable.get(t)) is None:
                continue
            if known == 2:
                reachable[t] = known = int(self.spine(t) is not None)
            if not known:
                continue
            if inner == length:
                return t, length
            key = stack[inner - length][0], t
            if (stands := fits.get(key)) is None:
                stands = fits[key] = self.stand(*key)
            if stands:
                return t, length
        raise ValueError(f"no token ends {word[:d]!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the distinct words with its tokens."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        stack: list[tuple[str, int]] = [("", 0)]
        before, end = "", self.end
        for word in sorted(words):
            inner = len(word) - 1 if end else len(word)  # the last symbol of a word is a leaf of its own
            shared, most = 0, min(len(before), inner, len(stack) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del stack[shared + 1 :]
            for d in range(shared + 1, inner + 1):
                stack.append(self._last(word, d, "", stack))
            at = self._last(word, len(word), end, stack) if end else stack[len(word)]
            tokens, d = [], len(word)
            while d > 0:
                tokens.append(at[0])
                d -= at[1]
                at = stack[d]
            tokens.reverse()
            yield word, tokens
            before = word


@functools.lru_cache(2)
def _setup(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    encoder = TrieEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    # the usual printable stand-ins of bytes
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
    return t, encoder, special, split, pattern, regex.compile(STABLE), shown


def words_of(path: str, text: str) -> list[str]:
    """The words of a text, in bytes shown as characters; special tokens stand as ('special', content)."""
    t, _, special, split, pattern, stable, shown = _setup(path)
    out: list = []
    for part in split.split(text) if "<|" in text else [text]:
        if part in special:
            out.append(("special", part))
        elif stable.fullmatch(part):
            out.extend(pattern.findall(part.lower()))
        elif part:
            low = t.normalizer.normalize_str(part)
            out.extend(pattern.findall(low) if stable.fullmatch(low) else (("shown", w) for w, _ in t.pre_tokenizer.pre_tokenize_str(low)))
    return out


def runs_of(path: str, text: str) -> list:
    """The text in parts that are encoded each by itself: no word holds white space, so runs between white space will do; odd texts come as their words."""
    stable = _setup(path)[5]
    if "<|" not in text and stable.fullmatch(text):
        return text.lower().split()
    return words_of(path, text)


class Coder:
    """Encodings seen so far, of words and of runs of words: ids in decimals and tokens, each joined by spaces, in bytes."""

    def __init__(self, path: str):
        self.path = path
        self.number = {t: b"%d" % i for t, i in _setup(path)[1].vocab.items()}
        self.forget()

    def forget(self) -> None:
        self.ids: dict = {}
        self.tokens: dict = {}

    def _encode(self, words: set) -> None:
        _, encoder, special, _, _, _, shown = _setup(self.path)
        as_shown: dict = {}  # the words by the characters that stand for their bytes
        for w in words:
            if not isinstance(w, tuple):
                as_shown.setdefault(w if w.isascii() else "".join([shown[b] for b in w.encode()]), []).append(w)
            elif w[0] == "special":
                self.ids[w], self.tokens[w] = b"%d" % special[w[1]], w[1].encode()
            else:
                as_shown.setdefault(w[1], []).append(w)
        number = self.number
        for s, own in encoder.encode(as_shown):
            ids, tokens = b" ".join([number[x] for x in own]), " ".join(own).encode()
            for w in as_shown[s]:
                self.ids[w], self.tokens[w] = ids, tokens

    def learn(self, runs: set) -> None:
        new = runs - self.ids.keys()
        if len(self.ids) + len(new) > 2 * REMEMBERED:
            self.forget()
            new = runs
        pattern = _setup(self.path)[4]
        words, parts = set(), {}
        for r in new:
            if isinstance(r, tuple) or r.isalpha():
                words.add(r)
            else:
                parts[r] = own = pattern.findall(r)
                words.update(own)
        ids, tokens = self.ids, self.tokens
        self._encode(words - ids.keys())
        for r, own in parts.items():
            if len(own) > 1:
                ids[r], tokens[r] = b" ".join([ids[w] for w in own]), b" ".join([tokens[w] for w in own])

    def code(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, the ids, the decoded text) of each text."""
        cut = [runs_of(self.path, t) for t in texts]
        self.learn(set().union(*cut))
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        for runs in cut:
            own = b" ".join(map(ids, runs))
            yield own.count(b" ") + 1 if runs else 0, own, b" ".join(map(tokens, runs))


def bpe(df: DataFrame, tokenizer: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Adds n_tokens, ids (array<int>) and decoded to the other columns, or with ``digests`` n_tokens and the SHA-256 of the ids (in decimals, one space between) and of the decoded text.

    Columns of the input with these names give way to the result, and the text
    is not returned.  Works block by block inside each partition: nothing is
    shuffled, and memory is bounded by the block and by REMEMBERED.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    others = [f for f in df.schema if f.name not in (text_col, *added)]
    kinds = [(f"c{k}", to_arrow_type(f.dataType)) for k, f in enumerate(others)]
    src = df.select(*[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)], F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(others)] + ["n_tokens long", *("ids_sha256 string", "decoded_sha256 string")] if digests else [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(others)] + ["n_tokens long", "ids array<int>", "decoded string"])

    def run(batches):
        coder = Coder(tokenizer)
        for _, rows, texts in blocks(batches, BLOCK):
            cols = {c: pa.array([r[c] for r in rows], k) for c, k in kinds}
            sizes, first, second = [], [], []
            for n, ids, decoded in coder.code(texts):
                sizes.append(n)
                first.append(hashlib.sha256(ids).hexdigest() if digests else [int(i) for i in ids.split()])
                second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
            cols["n_tokens"] = pa.array(sizes, pa.int64())
            cols[added[1]] = pa.array(first, pa.string() if digests else pa.list_(pa.int32()))
            cols[added[2]] = pa.array(second, pa.string())
            yield pa.RecordBatch.from_pydict(cols)
        # a worker kept for other tasks gives all of it back
        coder.forget()
        _setup.cache_clear()
        release()

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(others)], *added)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens of an id array joined by spaces (null: empty), as the library's decode of a model without a decoder."""
    _, encoder, special, *_ = _setup(tokenizer)
    names = [(i, t) for i, t in encoder.text.items()] + [(i, t) for t, i in special.items()]
    top = max(i for i, _ in names) + 1
    listed = [""] * top
    for i, t in names:
        listed[i] = t
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(listed)  # the vocabulary: of fixed size

    @F.pandas_udf("string")
    def joined(ids):
        return ids.map(lambda x: " ".join(shared.value[i] for i in x) if x is not None else "")

    return df.withColumn("decoded", joined(F.col(ids_col)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents by word_bpe_49k, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
