"""The closed vocabulary of normalized code tokens and its numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved words, operators and directives of both languages.
CPP_KEYWORDS = """alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t
class compl concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default
delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable
namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires
return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try
typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq""".split()
PYTHON_KEYWORDS = """False None True and as assert async await break class continue def del elif else except finally for
from global if import in is lambda nonlocal not or pass raise return try while with yield""".split()
CPP_OPERATORS = """<<= >>= ... ->* <=> :: -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^=
+ - * / % = < > ! & | ^ ~ ? : ; , . ( ) { } [ ]""".split()
PYTHON_OPERATORS = """**= //= <<= >>= ... ** // << >> <= >= == != -> := += -= *= /= %= &= |= ^= @=
+ - * / % = < > ! & | ^ ~ @ ( ) [ ] { } : , . ;""".split()
DIRECTIVES = ["#" + d for d in "define undef include if ifdef ifndef else elif endif line error warning pragma".split()]
CLASSES = ["IDENT", "NUM", "STR", "RAW"]

VOCABULARY = sorted({*CLASSES, *CPP_KEYWORDS, *PYTHON_KEYWORDS, *CPP_OPERATORS, *PYTHON_OPERATORS, *DIRECTIVES})
IDS = {norm: i for i, norm in enumerate(VOCABULARY)}
UNKNOWN = len(VOCABULARY)


def intern(norm: Column) -> Column:
    """Number of a normalized token; anything else is one more."""
    table = F.create_map(*[F.lit(x) for pair in IDS.items() for x in pair])
    return F.coalesce(F.element_at(table, norm), F.lit(UNKNOWN)).cast("long")
