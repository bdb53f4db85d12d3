"""Lexers: (grp, sub_id, source) -> token rows.

A lexer is a total alternation: its lexemes, laid end to end, are the source.  So
byte offsets, lines and columns are running sums over the lexemes.  The C++ and
prose lexers are one Java regular expression; Python's nested f-strings are not
regular, so its lexemes come from an Arrow UDF with a recursive pattern.

Columns of the result: grp, sub_id, pos, type, norm, tid, line, col, start_byte, end_byte.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..vocab import CPP_KEYWORDS, CPP_OPERATORS, PYTHON_KEYWORDS, PYTHON_OPERATORS, intern


def _any(operators: list[str]) -> str:
    return "|".join(re.escape(o) for o in sorted(operators, key=len, reverse=True))


_WS = r"[ \t\r\x0B\f]"
CPP = "|".join([
    rf"(?:\A|{_WS}*+\n){_WS.replace('f]', 'f' + chr(92) + 'n]')}*+#[ \t]*+(?:include(?![A-Za-z_])[^\n]*+|[A-Za-z_]*+)",
    r"[ \t\r\n\x0B\f]++",
    r"//[^\n]*+",
    r"/\*(?s:.)*?\*/",
    r"/\*(?s:.)*+",
    r"R\"([^(]*+)\((?s:.)*?\)\1\"",
    r"R\"(?s:.)*+",
    r"[A-Za-z_][A-Za-z0-9_]*+",
    r"(?=[0-9]|\.[0-9])(?:[0-9A-Za-z.']|(?<=[eEpP])[+-])++",
    r"\"(?:[^\"\\\n]|\\(?s:.)|\\\z)*+\"?",
    r"'(?:[^'\\\n]|\\(?s:.)|\\\z)*+'?",
    _any(CPP_OPERATORS),
    r"(?s:.)",
])
PROSE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def _placed(lexemes: DataFrame) -> DataFrame:
    """Adds start_byte and line of each lexeme (columns grp, sub_id, n, lexeme)."""
    before = W.partitionBy("grp", "sub_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length("lexeme").cast("long")
    lines = (F.length("lexeme") - F.length(F.replace("lexeme", F.lit("\n"), F.lit("")))).cast("long")
    since = F.when(lines > 0, F.length(F.substring_index("lexeme", "\n", -1))).cast("long")
    d = lexemes.withColumns({"size": size, "lines": lines, "chars": F.length("lexeme").cast("long"), "since": since})
    d = d.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("line", 1 + F.coalesce(F.sum("lines").over(before), F.lit(0)))
    # column: code points since the last line break
    d = d.withColumn("cp", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    head = F.last(F.when(F.col("lines") > 0, F.col("cp") + F.col("chars") - F.col("since")), ignorenulls=True).over(before)
    return d.withColumn("col", F.col("cp") - F.coalesce(head, F.lit(0)) + 1)


def _numbered(d: DataFrame) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("grp", "sub_id").orderBy("n")).cast("long") - 1
    return d.withColumn("pos", pos).select("grp", "sub_id", "pos", "type", "norm", "tid", "line", "col", "start_byte", "end_byte")


def _exploded(df: DataFrame, lexemes: Column) -> DataFrame:
    return df.select("grp", "sub_id", F.posexplode(lexemes).alias("n", "lexeme"))


def _ids(d: DataFrame) -> DataFrame:
    """(grp, sub_id, pos, tid) of typed lexemes, without places."""
    pos = F.row_number().over(W.partitionBy("grp", "sub_id").orderBy("n")).cast("long") - 1
    return d.select("grp", "sub_id", pos.alias("pos"), intern(F.col("norm")).alias("tid"))


def _lexemes_cpp(df: DataFrame) -> DataFrame:
    return _exploded(df, F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(CPP), F.lit(0)))


def _typed_cpp(d: DataFrame) -> DataFrame:
    """Adds bare (the lexeme without the white space a directive may begin with), lead (bytes of that), type and norm; types by the first character, so patterns are the exception."""
    x = F.col("lexeme")
    d = d.withColumn("bare", F.ltrim(x, F.lit(" \t\r\n\x0b\f")))
    b = F.col("bare")
    d = d.withColumn("lead", (F.octet_length(x) - F.octet_length(b)).cast("long")).withColumn("first", F.ascii(b))
    first, second = F.col("first"), F.ascii(F.substring(b, 2, 1))
    digit = lambda c: c.between(48, 57)
    is_directive = (first == ord("#")) & ((F.col("lead") > 0) | (F.col("n") == 0) | (F.length(b) > 1))
    word = F.concat(F.lit("#"), F.regexp_extract(b, r"\A#[ \t]*([A-Za-z_]*)", 1))
    closed = lambda q: b.rlike(rf"\A{q}(?:[^{q}\\\n]|\\(?s:.))*+{q}\z")
    kind = (
        F.when(b == "", None).when(b.startswith("//"), None)
        .when(b.startswith("/*"), F.when(b.rlike(r"(?s)\A/\*.*?\*/\z"), None).otherwise("Raw"))
        .when(is_directive, F.when(word == "#include", None).otherwise("Preproc"))
        .when(b.startswith('R"'), F.when(b.rlike(r'(?s)\AR"([^(]*+)\(.*?\)\1"\z'), "String").otherwise("Raw"))
        .when(first.between(97, 122) | first.between(65, 90) | (first == 95), F.when(b.isin(CPP_KEYWORDS), "Keyword").otherwise("Identifier"))
        .when(digit(first) | ((first == 46) & digit(second)), "Number")
        .when(first == ord('"'), F.when(closed('"'), "String").otherwise("Raw"))
        .when(first == ord("'"), F.when(closed("'"), "Char").otherwise("Raw"))
        .when(b.isin(CPP_OPERATORS), "Punct").otherwise("Raw")
    )
    d = d.withColumn("type", kind).where("type is not null")
    norm = (
        F.when(F.col("type") == "Preproc", word).when(F.col("type").isin("Keyword", "Punct"), b).when(F.col("type") == "Identifier", "IDENT")
        .when(F.col("type") == "Number", "NUM").when(F.col("type").isin("String", "Char"), "STR").otherwise("RAW")
    )
    return d.withColumn("norm", norm)


def lex_cpp(df: DataFrame) -> DataFrame:
    d = _typed_cpp(_placed(_lexemes_cpp(df)))
    x, b = F.col("lexeme"), F.col("bare")
    head = F.substring(x, F.lit(1), F.length(x) - F.length(b))
    breaks = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    d = d.withColumn("col", F.when(breaks > 0, F.length(F.substring_index(head, "\n", -1)) + 1).otherwise(F.col("col") + F.length(head)))
    d = d.withColumn("line", F.col("line") + breaks).withColumn("start_byte", F.col("at") + F.col("lead")).withColumn("end_byte", F.col("at") + F.col("size")).withColumn("tid", intern(F.col("norm")))
    return _numbered(d)


def cpp_ids(df: DataFrame) -> DataFrame:
    return _ids(_typed_cpp(_lexemes_cpp(df)))


@functools.lru_cache(1)
def _python_pattern():
    import regex

    strings = []
    for q in ("'", '"'):
        inner = rf"(?:[^{q}\\\n]|\\.|\\\Z)*+"
        part = rf"(?:\\.|\\\Z|\{{\{{|\}}|(?&expr)|[^\\{{}}%s])"
        for f, kinds in (("f", r"(?:[fF][rRbBuUfF]?|[rRbBuU][fF])"), ("", r"(?:[rRbBuU]{0,2})")):
            for mark, quote in (("3", q * 3), ("1", q)):
                if f:
                    body = rf"(?>{part % (q + chr(92) + 'n')})*+" if mark == "1" else rf"(?>(?!{quote}){part % ''})*+"
                else:
                    body = inner if mark == "1" else rf"(?>(?!{quote})(?:\\.|\\\Z|[^\\]))*+"
                guard = rf"(?!{q}{q}{q})" if mark == "1" else ""
                # an expression that never closes takes all that is left
                open_ = r"(?:(?P>open))?+" if f else ""
                strings.append((mark, rf"{kinds}{guard}{quote}{body}(?:(?P<ok>{quote})|{open_})"))
    expr = r"""(?(DEFINE)(?P<str>"(?:[^"\\\n]|\\.|\\\Z)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.|\\\Z)*+(?:'|(?=\n)|\Z))(?P<expr>\{(?>[^{}"']|(?P>str)|(?P>expr))*+\})(?P<open>\{(?>[^{}"']|(?P>str)|(?P>expr)|(?P>open))*+\Z))"""
    triple_first = [s for m, s in sorted(strings, key=lambda x: x[0], reverse=True)]
    alternatives = [
        r"(?P<ws>[ \t\r\n\x0b\f]++|#[^\n]*+)",
        *triple_first,
        r"(?P<word>[A-Za-z_][A-Za-z0-9_]*+)",
        r"(?P<num>(?=[0-9]|\.[0-9])(?:[0-9A-Za-z._]|(?<=[eE])[+-])++)",
        rf"(?P<op>{_any(PYTHON_OPERATORS)})",
        r"(?P<raw>.)",
    ]
    return regex.compile(expr + "(?:" + "|".join(alternatives) + ")", regex.S)


def python_lexemes(source: str) -> list[tuple[str, str | None]]:
    """(lexeme, type) of a Python source; type None is dropped."""
    pattern = _python_pattern()
    out = []
    for m in pattern.finditer(source):
        g = m.groupdict()
        x = m.group()
        if g["ws"] is not None:
            kind = None
        elif g["word"] is not None:
            kind = "Keyword" if x in PYTHON_KEYWORDS else "Identifier"
        elif g["num"] is not None:
            kind = "Number"
        elif g["op"] is not None:
            kind = "Punct"
        elif g["raw"] is not None:
            kind = "Raw"
        else:
            kind = "String" if g["ok"] is not None else "Raw"
        out.append((x, kind))
    return out


def _lexemes_python(df: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<lexeme:string,type:string>>")
    def _python_udf(sources):
        return sources.map(lambda s: [{"lexeme": a, "type": b} for a, b in python_lexemes(s or "")])

    return df.select("grp", "sub_id", F.posexplode(_python_udf("source")).alias("n", "x")).select("grp", "sub_id", "n", "x.lexeme", "x.type")


def _typed_python(d: DataFrame) -> DataFrame:
    x, t = F.col("lexeme"), F.col("type")
    norm = F.when(t.isin("Keyword", "Punct"), x).when(t == "Identifier", "IDENT").when(t == "Number", "NUM").when(t == "String", "STR").otherwise("RAW")
    return d.where("type is not null").withColumn("norm", norm)


def lex_python(df: DataFrame) -> DataFrame:
    d = _typed_python(_placed(_lexemes_python(df)))
    d = d.withColumn("start_byte", F.col("at")).withColumn("end_byte", F.col("at") + F.col("size"))
    return _numbered(d.withColumn("tid", intern(F.col("norm"))))


def python_ids(df: DataFrame) -> DataFrame:
    return _ids(_typed_python(_lexemes_python(df)))


def word_id(word: Column) -> Column:
    """A number under 2^24 from the word's md5."""
    return F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long")


def lex_prose(df: DataFrame) -> DataFrame:
    d = _placed(_exploded(df, F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(f"({PROSE})"), F.lit(1))))
    d = d.where(F.col("lexeme").rlike(r"\A[\p{L}\p{N}]")).withColumn("norm", F.lower("lexeme")).withColumn("type", F.lit("Identifier"))
    d = d.withColumn("tid", word_id(F.col("norm"))).withColumn("start_byte", F.col("at")).withColumn("end_byte", F.col("at") + F.col("size"))
    return _numbered(d)


def prose_ids(df: DataFrame) -> DataFrame:
    """(grp, sub_id, pos, tid) of prose without offsets: no running sums."""
    words = F.regexp_extract_all(F.lower(F.coalesce("source", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return df.select("grp", "sub_id", F.posexplode(words).alias("pos", "norm")).select("grp", "sub_id", F.col("pos").cast("long").alias("pos"), word_id(F.col("norm")).alias("tid"))


#: The extension point: a language's lexer by name.
LEXERS: dict[str, Callable[[DataFrame], DataFrame]] = {"cpp": lex_cpp, "python": lex_python, "prose": lex_prose}


#: The same without places, for steps that need none.
LIGHT: dict[str, Callable[[DataFrame], DataFrame]] = {"cpp": cpp_ids, "python": python_ids, "prose": prose_ids}


def lex(df: DataFrame, lexers: dict[str, Callable[[DataFrame], DataFrame]] = LEXERS) -> DataFrame:
    """Tokens of submissions (grp, sub_id, language, source) by their languages' lexers."""
    out = None
    for name, lexer in lexers.items():
        own = lexer(df.where(F.col("language") == name))
        out = own if out is None else out.unionByName(own)
    return out


def lex_ids(df: DataFrame) -> DataFrame:
    """(grp, sub_id, pos, tid) of submissions by their languages' lexers."""
    return lex(df, LIGHT)
