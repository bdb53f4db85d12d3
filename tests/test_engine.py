import os
import random

import pytest
from pyspark.sql import functions as F

from winnowry import Params, vocab
from winnowry.functions import scalars as S
from winnowry.operators import lexers as L
from winnowry.operators import matching as M
from winnowry.operators.fingerprint import kgram_hashes, winnow
from winnowry.plans import report as R
from winnowry.plans.analysis import analyze
from winnowry.sources import ingest as I

SUBS = "grp string, sub_id string, language string, source string"


def lexed(spark, lexer, source):
    df = spark.createDataFrame([("g", "s", "x", source)], SUBS)
    return [(r.type, r.norm, r.line, r.start_byte, r.end_byte) for r in lexer(df).orderBy("pos").collect()]


def test_vocabulary():
    assert len(vocab.VOCABULARY) == 188 == vocab.UNKNOWN
    assert {k: vocab.IDS[k] for k in ("!", "#define", "IDENT", "NUM", "RAW", "STR", "for", "int", "~")} == {"!": 0, "#define": 2, "IDENT": 60, "NUM": 61, "RAW": 63, "STR": 64, "for": 120, "int": 129, "~": 187}


@pytest.mark.parametrize("source, norms", [
    ("int a; // x\n/* y\nz */ int b;", "int IDENT ; int IDENT ;"),
    ('x = "a\\"b" + \'c\';', "IDENT = STR + STR ;"),
    ('R"d(a)b)d" R"(q)"', "STR STR"),
    ("#include <a>\n#define N 10\n  #odd\n", "#define IDENT NUM #odd"),
    ("1'000'000 0x1Fu 1.5e-3 .5f 1abc", "NUM NUM NUM NUM NUM"),
    ("a # b", "IDENT RAW IDENT"),
    ('LR"(a)"', "IDENT STR"),
    ('"open\nint', "RAW int"),
    ("x /* open", "IDENT RAW"),
    ("a<<=b->*c<=>d", "IDENT <<= IDENT ->* IDENT <=> IDENT"),
    ("", ""),
])
def test_cpp(spark, source, norms):
    assert " ".join(t[1] for t in lexed(spark, L.lex_cpp, source)) == norms


def test_cpp_places(spark):
    got = lexed(spark, L.lex_cpp, "int é $;\n  \"ü\"")
    assert [(t[1], *t[2:]) for t in got] == [("int", 1, 0, 3), ("RAW", 1, 4, 6), ("RAW", 1, 7, 8), (";", 1, 8, 9), ("STR", 2, 12, 16)]


@pytest.mark.parametrize("source, kinds", [
    ("f'{a[\"k\"]}' x", ["String", "Identifier"]), ("f'{{}}' '''a\nb''' rb\"\"", ["String", "String", "String"]),
    ("f'{a:{w}}'", ["String"]), ("'ab\nc", ["Raw", "Identifier"]), ("f'{x' ", ["Raw"]), ('"""open', ["Raw"]),
    ("1_000j 1e-5 0x1F", ["Number"] * 3), ("# c\nif True: $", ["Keyword", "Keyword", "Punct", "Raw"]), ("match _ type", ["Identifier"] * 3), ("", []),
])
def test_python(source, kinds):
    assert [k for _, k in L.python_lexemes(source) if k] == kinds
    assert "".join(x for x, _ in L.python_lexemes(source)) == source


def test_renaming_changes_nothing(spark):
    a, b = ("def f(alpha, beta):\n    return alpha + beta * 2", "def g(x1, yy):\n    return x1 + yy * 7")
    assert [t[1] for t in lexed(spark, L.lex_python, a)] == [t[1] for t in lexed(spark, L.lex_python, b)]


def _tokens(spark, ids):
    return spark.createDataFrame([("g", "s", i, t) for i, t in enumerate(ids)], "grp string, sub_id string, pos long, tid long")


def test_kgrams(spark):
    got = kgram_hashes(_tokens(spark, [1, 2, 3]), 2).orderBy("pos").collect()
    assert [(r.h1, r.h2) for r in got] == [(131073, 524289), (262145, 1048577)]
    assert kgram_hashes(_tokens(spark, [1, 2]), 5).count() == 0


def _winnowed(spark, hashes, w):
    df = spark.createDataFrame([("g", "s", i, h, h, len(hashes)) for i, h in enumerate(hashes)], "grp string, sub_id string, pos long, h1 long, h2 long, n_grams long")
    return [(r.pos, r.h1) for r in winnow(df, w).orderBy("pos").collect()]


def test_winnowing(spark):
    assert _winnowed(spark, [77, 74, 42, 17, 98, 50, 17, 98, 8, 88, 67, 39, 77, 74, 42, 17, 98], 4) == [(3, 17), (6, 17), (8, 8), (11, 39), (15, 17)]
    assert _winnowed(spark, [5, 2, 9], 4) == [(1, 2)]
    with pytest.raises(ValueError):
        winnow(None, 0)
    r = random.Random(3)
    for _ in range(3):
        h = [r.randrange(6) for _ in range(60)]
        want = sorted({max(range(i, i + 4), key=lambda p: (-h[p], p)) for i in range(57)})
        assert [p for p, _ in _winnowed(spark, h, 4)] == want


def test_regions(spark):
    pp = spark.createDataFrame([("g", "a", "b", *p) for p in [(1, 10), (2, 11), (3, 12)]], "grp string, a string, b string, pa long, pb long")
    assert [(r.tokens, r.a_first, r.b_last) for r in M.regions(pp, 3, 4).collect()] == [(5, 1, 14)]
    crossed = spark.createDataFrame([("g", "a", "b", 0, 5), ("g", "a", "b", 1, 3)], "grp string, a string, b string, pa long, pb long")
    assert [r.tokens for r in M.regions(crossed, 3, 4).collect()] == [3, 3]


def test_exclusion(spark):
    fp = spark.createDataFrame([("g", s, 1, 1, 0) for s in "abcd"] + [("g", s, 2, 2, 1) for s in "ab"], "grp string, sub_id string, h1 long, h2 long, pos long")
    subs = spark.createDataFrame([("g", s) for s in "abcd"], "grp string, sub_id string")
    assert [(r.h1) for r in M.excluded(fp, subs, Params()).collect()] == [1]
    assert {r.h1 for r in M.filtered(fp, subs, Params()).collect()} == {2}
    starter = spark.createDataFrame([(2, 2)], "h1 long, h2 long")
    assert M.filtered(fp, subs, Params(), starter).count() == 0


def test_scores(spark):
    rows = [("g", "a", h, 0, h) for h in (10, 20, 30, 40, 50)] + [("g", "b", h, 0, h) for h in (20, 30, 40, 999)]
    fp = spark.createDataFrame(rows, "grp string, sub_id string, h1 long, h2 long, pos long")
    r = M.score(M.candidates(fp, 1), fp, 0.35).first()
    assert (r.shared, r.sim_a_to_b, r.sim_b_to_a, r.flagged) == (3, 0.6, 0.75, True)


def test_analysis_of_generated_copies(spark):
    subs = I.generated(spark, 12, 0.4, 0.3, 60)
    a = analyze(subs)
    flagged = {(r.a, r.b) for r in a.scored.where("flagged").collect()}
    by_text = {}
    for r in subs.collect():
        by_text.setdefault(r.source, []).append(r.sub_id)
    copies = {(min(x, y), max(x, y)) for own in by_text.values() for x in own for y in own if x != y}
    assert copies and copies <= flagged
    p = a.pairs().where("sim_a_to_b = 1 and sim_b_to_a = 1").first()
    src = {r.sub_id: r.source.encode() for r in subs.collect()}
    g = p.regions[0]
    assert src[p.a][g.a_start : g.a_end] == src[p.b][g.b_start : g.b_end]


def test_params():
    for bad in (dict(k=0), dict(w=0), dict(flag_threshold=2)):
        with pytest.raises(ValueError):
            Params(**bad)


def test_utf16(spark):
    df = spark.createDataFrame([("é中😀x", b) for b in range(11)], "s string, b int")
    assert [r[0] for r in df.select(S.utf16_offset(F.col("s"), F.col("b"))).collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 4, 5]


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (2.0, "c")], "v double, id string")
    one = R.seek_page(df, "v", "id", 2).collect()
    assert [r.id for r in one] == ["c", "a"] and one[0].next_cursor is None
    two = R.seek_page(df, "v", "id", 2, one[1].next_cursor).collect()
    assert [r.id for r in two] == ["b"] and two[0].next_cursor is None
    for bad in ("", "x", "e30"):
        with pytest.raises(ValueError):
            S.decode_cursor(bad)


def test_spans(spark):
    t = spark.createDataFrame([("d", 10), ("e", 4)], "doc string, length long")
    r = spark.createDataFrame([("d", 0, 2, 6), ("d", 1, 4, 8)], "doc string, region_id int, start long, end long")
    got = [tuple(x) for x in R.highlight_spans(t, r).orderBy("doc", "start").collect()]
    assert got == [("d", 0, 2, []), ("d", 2, 4, [0]), ("d", 4, 6, [0, 1]), ("d", 6, 8, [1]), ("d", 8, 10, []), ("e", 0, 4, [])]
    beyond = spark.createDataFrame([("d", 0, -3, 6), ("d", 1, 4, 18)], "doc string, region_id int, start long, end long")
    got = [tuple(x) for x in R.highlight_spans(t, beyond).where("doc = 'd'").orderBy("start").collect()]
    assert got == [("d", 0, 4, [0]), ("d", 4, 6, [0, 1]), ("d", 6, 10, [1])]


def test_ingest(spark):
    good = ("1", "u", "p", "cpp", "int x;")
    assert I.direct(spark, [good]).count() == 1
    for bad in ([], [good, good], [("2", "", "p", "cpp", "x")], [("2", "u", "p", "java", "x")]):
        with pytest.raises(ValueError):
            I.direct(spark, bad)


def test_paged_source(spark):
    def fetch(key, cursor, size):
        at = int(cursor or 0)
        return [(f"{key}{at}", "u", key, "cpp", "int x;")], (str(at + 1) if at < 2 else None)

    got = I.paged_source(spark, fetch, ["p", "q"])
    assert {r.external_id for r in got.collect()} == {f"{k}{i}" for k in "pq" for i in range(3)}


def test_paged_source_tries_again(spark, tmp_path):
    def fetch(key, cursor, size, seen=str(tmp_path)):
        import os
        import uuid

        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(seen)) < 3:
            raise OSError("busy")
        return [(f"{key}{size}", "u", key, "cpp", "int x;")], None

    got = I.paged_source(spark, fetch, ["p"], attempts=4, backoff_ms=1, page_size=7)
    assert [r.external_id for r in got.collect()] == ["p7"]
    down = I.paged_source(spark, lambda key, cursor, size: 1 / 0, ["p"], attempts=2, backoff_ms=1)
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        down.collect()


def test_snapshots_replace(spark, tmp_path):
    path = str(tmp_path / "s")
    df = lambda *s: spark.createDataFrame([(str(i), "u", "p", "cpp", x) for i, x in enumerate(s)], I.SUBMISSION)
    I.write_snapshots(df("a", "b" * 70_000), "one", path)
    I.write_snapshots(df("other"), "two", path)
    I.write_snapshots(df("a", "b" * 70_000, "c"), "one", path)
    got = I.snapshots(spark, path, "one").collect()
    assert {(r.external_id, r.source_encoding) for r in got} == {("0", "utf8"), ("1", "gzip"), ("2", "utf8")}
    assert I.snapshots(spark, path, "two").count() == 1
    assert I.usable(df("a", "b" * 300_000)).count() == 1
    for bad in ((), ("b" * 300_000,)):
        with pytest.raises(ValueError):
            I.usable(df(*bad) if bad else df("x").where("false"))


def test_corpus_files(spark, tmp_path):
    for name, text in (("sol1.cpp", "int a;"), ("var_b.cpp", "int b;"), ("notes.txt", "no")):
        (tmp_path / name).write_text(text)
    assert {(r.sub_id, r.source) for r in I.corpus(spark, str(tmp_path)).collect()} == {("sol1", "int a;"), ("var_b", "int b;")}


@pytest.mark.skipif(not os.environ.get("GOLDEN_CORPUS"), reason="GOLDEN_CORPUS names no folder of sources")
def test_golden_corpus(spark):
    """Published counts of the corpus described in FIXTURES.md: 18 files, 1,094 fingerprints, 35 candidates, 18 flagged."""
    a = analyze(I.corpus(spark, os.environ["GOLDEN_CORPUS"]))
    r = a.stats().first()
    assert (r.submissions, r.fingerprints, r.candidate_pairs, r.flagged_pairs) == (18, 1094, 35, 18)


def test_jobs(spark, tmp_path):
    from winnowry.streaming import jobs

    subs = I.generated(spark, 6, 0.6, 0.2, 40).select(F.col("sub_id").alias("external_id"), F.lit("u").alias("user_ref"), F.col("grp").alias("problem_ref"), "language", "source")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"analysis_id": "x", "submitted_at": "2024-01-01T00:00:00Z"}\n' * 2)
    base = str(tmp_path / "out")
    q = jobs.serve(spark, str(tmp_path / "in"), lambda _: subs, base)
    q.awaitTermination(120)
    first = spark.read.parquet(f"{base}/pairs").count()
    said = []
    assert jobs.run_analysis(spark, "x", subs, base, notify=lambda b, s: said.append((b, s)), secret="k") == "completed"
    assert spark.read.parquet(f"{base}/pairs").count() == first and S.signature(said[0][0], "k") == said[0][1]
    assert spark.read.schema(jobs.STATUS).parquet(f"{base}/status").where("status = 'completed'").count() == 1
    assert jobs.run_analysis(spark, "y", subs.where("false"), base) == "failed"


def _submissions(spark):
    return I.generated(spark, 6, 0.6, 0.2, 40).select(F.col("sub_id").alias("external_id"), F.lit("u").alias("user_ref"), F.col("grp").alias("problem_ref"), "language", "source")


def test_broken_off_jobs_end_the_same(spark, tmp_path):
    """An analysis that breaks off at each step in turn ends with the same pairs and is completed once."""
    from winnowry.streaming import jobs

    subs = _submissions(spark)
    base = str(tmp_path / "out")
    jobs.submit(spark, "whole", base, Params(flag_threshold=0.5))
    assert jobs.latest(jobs._log(spark, f"{base}/status")).first()["status"] == "queued" and jobs.frozen(spark, "whole", base) == Params(flag_threshold=0.5)
    jobs.submit(spark, "whole", base, Params())  # changes nothing
    assert jobs.frozen(spark, "whole", base).flag_threshold == 0.5 and jobs.frozen(spark, "none", base) is None
    assert jobs.run_analysis(spark, "whole", lambda: subs, base) == "completed"
    left = ["fetch", "snapshots", "fingerprints", "pairs"]

    def fault(step):
        if left and step == left[0]:
            raise RuntimeError(left.pop(0))

    jobs.submit(spark, "broken", base, Params(flag_threshold=0.5), "https://x.example/hook")
    assert jobs.run_analysis(spark, "broken", lambda: subs, base, attempts=5, pause_s=0, fault=fault) == "completed" and not left
    pairs = spark.read.parquet(f"{base}/pairs").drop("analysis_id")
    of = lambda x: sorted(map(str, spark.read.parquet(f"{base}/pairs").where(F.col("analysis_id") == x).select(pairs.columns).collect()))
    assert of("whole") == of("broken") != []
    log = spark.read.schema(jobs.STATUS).parquet(f"{base}/status")
    assert log.where("status = 'completed'").groupBy("analysis_id").count().where("count <> 1").count() == 0
    assert {r.progress for r in log.where("analysis_id = 'whole'").collect()} == {0, 10, 60, 95, 100}

    def always(step):
        raise OSError("gone")

    assert jobs.run_analysis(spark, "dead", subs, base, attempts=2, pause_s=0, fault=always) == "failed"
    assert [tuple(r) for r in spark.read.parquet(f"{base}/dead").select("analysis_id", "attempts", "error").collect()] == [("dead", 2, "gone")]
    everything = jobs.analyses(spark, base)
    assert {(r.analysis_id, r.status) for r in R.list_analyses(everything).collect()} == {("whole", "completed"), ("broken", "completed")}
    assert R.list_analyses(everything, "failed").count() == 0 and "webhook" not in R.list_analyses(everything).columns
    page = R.list_analyses(everything, limit=1).first()
    assert page.analysis_id == "broken" and R.list_analyses(everything, limit=1, cursor=page.next_cursor).first().analysis_id == "whole"
    one = R.get_analysis(everything, "broken").first()
    assert one.status == "completed" and "flag_threshold" in one.params and "webhook" not in one.asDict() and R.get_analysis(everything, "x").count() == 0
    assert tuple(R.admin_stats(everything).first())[0] == 2
    with pytest.raises(ValueError):
        jobs.submit(spark, "bad", base, webhook="ftp://x")


def test_webhooks_are_tried_again(spark, tmp_path):
    from winnowry.streaming import jobs

    tries = []

    def notify(body, sign):
        tries.append(body)
        if len(tries) < 3:
            raise OSError("down")

    base = str(tmp_path)
    assert jobs.deliver(spark, "x", "{}", notify, "k", base, pause_s=0) and len(tries) == 3
    assert not jobs.deliver(spark, "y", "{}", lambda b, s: 1 / 0, "k", base, pause_s=0)
    got = {(r.analysis_id, r.delivered, r.attempts) for r in spark.read.parquet(f"{base}/webhooks").collect()}
    assert got == {("x", True, 3), ("y", False, 3)}


def test_deferred_submits_fetch_when_they_run(spark):
    def fetch(key, cursor, size):
        return [(key, "u", "p", "cpp", "int x;")], None

    later = I.deferred(spark, fetch, "contest", ["a", "b"])
    assert {r.external_id for r in later().collect()} == {"contest/a", "contest/b"}


def test_pairs_and_matrix(spark):
    pairs = spark.createDataFrame([("g", "a", "b", 0.2, 0.9, 5, True), ("g", "a", "c", 0.5, 0.1, 5, True), ("f", "x", "y", 0.3, 0.3, 5, False)], "grp string, a string, b string, sim_a_to_b double, sim_b_to_a double, shared long, flagged boolean")
    assert [(r.grp, r.b) for r in R.score_matrix(pairs).collect()] == [("f", "y"), ("g", "b"), ("g", "c")]
    subs = spark.createDataFrame([("g", "a", "A"), ("g", "b", "B")], "grp string, sub_id string, source string")
    assert [(r.a_source, r.b_source) for r in R.get_pair(pairs, subs, "g", "a", "b").collect()] == [("A", "B")]
    assert R.get_pair(pairs, subs, "g", "a", "c").count() == 0


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(S.progress(F.lit(n), F.lit(8), 10, 80)) for n in (0, 1, 4, 8)] == [10, 20, 50, 89]
    assert tuple(get(S.marked_span(F.lit("é<x>ü</x>"), "<x>", "</x>"))) == (5, 7)
    assert [get(S.filename_id(F.lit(p))) for p in ("/c/sol12.cpp", "/c/var_a.cpp", "/c/evasion_3.cpp", "/c/x.cpp")] == ["sol12", "var_a", "evasion_3", ""]
    assert [get(S.callback_ok(F.lit(u))) for u in ("https://a/b", "HTTP://a", "ftp://a", "x y", None)] == [True, True, False, False, False]
    assert get(S.hash_key(F.lit(3), F.lit(4))) == "3:4"


def test_shared_runs_are_found(spark):
    """A run of w + k - 1 tokens in common leaves a common fingerprint, wherever it stands; density is near 2 / (w + 1)."""
    from winnowry.operators.fingerprint import fingerprints

    r = random.Random(5)
    k, w = 5, 4
    rows, want = [], []
    for case in range(60):
        run = [r.randrange(1000) for _ in range(w + k - 1)]
        for side in "ab":
            ids = [r.randrange(1000, 10**6) for _ in range(r.randrange(30))] + run + [r.randrange(1000, 10**6) for _ in range(r.randrange(30))]
            rows += [(str(case), side, i, t) for i, t in enumerate(ids)]
        want.append(str(case))
    long = [("long", "a", i, r.randrange(10**6)) for i in range(20_000)]
    fp = fingerprints(spark.createDataFrame(rows + long, "grp string, sub_id string, pos long, tid long"), k, w)
    found = {x.grp for x in fp.where("grp <> 'long'").groupBy("grp", "h1", "h2").agg(F.countDistinct("sub_id").alias("n")).where("n = 2").collect()}
    assert found == set(want)
    assert abs(fp.where("grp = 'long'").count() / 20_000 - 2 / (w + 1)) < 0.02


ORACLES = ["tokens_cpp", "tokens_python", "exclusion_set", "frequent_set", "filtered_fp", "conversation_dups", "unfinished_requests", "basket_candidates", "arg_max_region", "orders_seek", "candidate_pairs", "region_islands", "region_byte_ranges", "pair_report", "highlight_spans", "contamination", "pair_quality", "pairs_page2", "token_offsets"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, sf, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in "documents benchmark labels conversations pages lineitem orders events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = e.queries()[name](spark, sf), con.sql(e.oracle_sql()[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    want = sorted(map(str, b.select(*[f'"{c}"' for c in cols]).fetchall()))
    got = sorted(str(tuple(r)) for r in a.select(*cols).collect())
    assert got == want and (got or name in ("contamination", "pairs_page2", "frequent_set", "exclusion_set", "conversation_dups", "unfinished_requests"))  # few rows at this scale
    spark.catalog.clearCache()


def _brute_regions(a, b, p):
    """Byte ranges in a of the regions of two documents, by the rule of the SQL."""
    pairs = sorted((x[1], y[1], i) for i, x in enumerate(a) for y in b if x[0] == y[0])
    islands = []
    for n, (x, y, i) in enumerate(pairs):
        go_on = n and x - pairs[n - 1][0] <= p.w and 1 <= y - pairs[n - 1][1] <= p.w
        islands[-1:] = [[*islands[-1], (x, i)]] if go_on else [*islands[-1:], [(x, i)]]
    ranked = sorted(enumerate(islands), key=lambda r: (r[1][0][0] - r[1][-1][0], r[1][0][0], r[0]))
    return [(a[r[0][1]][2], a[r[-1][1]][3]) for _, r in ranked[: p.max_regions]]


def test_packed_regions_by_chunks(monkeypatch):
    import numpy as np

    from winnowry.operators import packed as K

    r = random.Random(9)
    for case in range(60):
        p = Params(k=3, w=4, max_regions=r.choice([3, 200]))
        side = lambda: [(r.randrange(4), pos, pos * 7, pos * 7 + 20) for pos in sorted(r.sample(range(60), r.randrange(1, 30)))]
        a, b = side(), side()
        monkeypatch.setattr(K, "CHUNK", r.choice([1, 5, 1 << 20]))
        by_hash = np.array(sorted((h, pos) for h, pos, *_ in b)).T
        got = K.regions(list(np.array(a).T), list(by_hash), p)
        assert list(zip(*[x.tolist() for x in got], strict=True)) == _brute_regions(a, b, p), case


def test_packed_columns():
    import numpy as np

    from winnowry.operators import packed as K

    cols = [np.array([1 << 59, 0, -5]), np.array([-(1 << 62), 7, 1 << 62]), np.array([3, 3, 3])]
    assert all((x == y).all() for x, y in zip(cols, K.unpack(K.pack(*cols), 3), strict=True))
    few = K._few([np.array([5, 5, 5, 5, 9, 5]), np.array([1, 1, 2, 3, 3, 4])], 2)
    assert few[1].tolist() == [1, 1, 2, 3, 3]  # one document more than the cap is enough to exclude a hash
    text = "ΟΔΟΣ İx 😀é9_a"
    ids, start, end = K.words(text)
    assert [text.encode()[s:e].decode() for s, e in zip(start, end, strict=True)] == ["ΟΔΟΣ", "İx", "é9", "a"]
    assert ids.tolist() == [K._Ids()[w] for w in ("οδοσ", "ix", "é9", "a")]


def test_highlight_spans_of_odd_texts(spark, tmp_path):
    """Neither tokens nor position pairs are rows, and odd texts give what the SQL gives."""
    import duckdb

    import __spark_entry__ as e

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdéßσΣİ中😀") for _ in range(3))
    passage = " ".join(f"{word()}{i}" for i in range(60))
    again = " ".join(["one two three four five six seven eight nine ten"] * 25)
    fresh = lambda n: " ".join(f"{word()}{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{fresh(20)} {passage if i % 3 else again} {fresh(i)}", "en") for i in range(9)]
    rows += [(20, None, "en"), (21, "", "en"), (22, "?! --", "en"), (23, passage[:20], "en"), (24, passage, None), (None, passage, "en"), (-3, passage, "en")]
    rows += [(i, fresh(30), "en") for i in range(30, 50)]
    rows += [(4, fresh(9) + again + passage, "de"), (60, again + passage, "de"), (61, again, "de"), (62, fresh(12), "de"), (63, fresh(12), "de"), (64, fresh(12), "de")]
    rows += [(i, "the same words in every one of the many texts of a small group " + fresh(5), "fr") for i in range(70, 74)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(passage.split()[20:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = e.queries()["highlight_spans"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString()
    cols = ["doc", "start", "end", "n_regions", "first_region"]
    want = con.sql(e.oracle_sql()["highlight_spans"]).select(*[f'"{c}"' for c in cols]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got.select(*cols).collect()) and any(x[3] > 1 for x in want)
    assert "posexplode" not in plan
    spark.catalog.clearCache()
