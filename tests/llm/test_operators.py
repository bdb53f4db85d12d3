"""Each operator on a small table with nulls, empty, blank, odd and long texts, ties, repeated rows and clashing extra columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from winnowry.llm import attention, bpe, chat, fingerprints, html_text, jaccard, lm_scores, mixing, quality, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "One two", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("w30", "x"), "a　b \x1c c d \x85", "Σας ΑΣ İ 日本語 😀 é é ١٢ ½",
    "x<|endoftext|>y <|startoftext|> z", "don't 'S we'll\r\n\r\n  go", "line\nline\nother\nline # * $", "ab " * 4000, "q" * 3000, "a\x00b", "x y x y x y x y x y x y",
]
#: Names that operators use for columns of their own.
CLASHES = ["id", "block", "bucket", "node", "score", "n_words", "target", "cut", "whole", "source_size", "size", "hash", "copies", "mix", "grp", "scale", "m0", "i0_0", "measures", "fit", "base_failed", "kept", "predicted", "flagged",
           "n_tokens", "ids", "decoded", "key", "gone", "row_key", "component_id", "range", "following", "sk", "next_text", "held_out", "html", "c0", "payload"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s10"][i % 4], 0, *CLASHES) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, BASE + " other", "en", "s1", 0, *CLASHES)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert rows_of(token_counts.token_counts(docs, path)) == want
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.bpe(docs.select("doc_id", "text"), path)
    for r, g in zip(docs.collect(), got.collect(), strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (g.doc_id, g.ids, g.n_tokens, g.decoded) == (r.doc_id, ids, len(ids), t.decode(ids, skip_special_tokens=False))
    assert bpe.decode(got.drop("decoded"), path).select("decoded").collect() == got.select("decoded").collect()
    assert bpe.bpe(none, path, digests=True).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(g.taken <= 2 * g.size for g in got)
    assert rows_of(mixing.mix(docs)) == Counter(map(tuple, got))
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    target = {g.source: g.target for g in got}
    assert {g.source: g.source_size for g in got} == dict(size)
    # brute force water filling
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        rest = left - sum(2 * size[s] for s in full)
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        full.update(over)
    want = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(docs).count() == sum(g.copies for g in got) and mixing.mixed(docs).columns == docs.columns


def taken_by(rows, goals):
    """How often each row goes in, by sorting: rows (source, hash, size), goals {source: (size, target)}."""
    out = []
    for source, (size, target) in goals.items():
        own = sorted(((h, n) for s, h, n in rows if s == source))
        whole = int(target // size) if size else 0
        goal, have, cut = target - whole * size, 0, 0
        by = {}
        for h, n in own:
            by[h] = by.get(h, 0) + n
        for h in sorted(by) if goal > 0 else ():
            if have >= goal:
                break
            if by[h] and abs(have + by[h] - goal) <= abs(have - goal):
                cut = h + 1
            elif by[h]:
                cut = h
            have += by[h]
        out += [(source, h, n, whole + (h < cut)) for h, n in own]
    return Counter(out)


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing_by_sorting(spark, sf, docs, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        h = df.select("doc_id", "source", mixing.hashed("doc_id", "text", 17).alias("h"), mixing.sized(df).alias("n")).collect()
        got = mixing.mix(df).collect()
        goals = {r.source: (r.source_size, r.target) for r in got}
        want = taken_by([(r.source, r.h, r.n) for r in h], goals)
        sizes = Counter()
        for (source, _, n, copies), k in want.items():
            sizes[source, n, copies] += k
        mine = Counter((r.source, r.size, r.copies) for r in got)
        assert {k: v for k, v in mine.items() if k[1]} == {k: v for k, v in sizes.items() if k[1]}
        whole = mixing.mixed(df)
        assert whole.columns == df.columns and rows_of(whole.select("doc_id")) == sum((Counter({(r.doc_id,): r.copies}) for r in got), Counter())


def test_mixing_comes_near(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), (1 + F.col("id") % 9).cast("int")).alias("text"))
    got = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 9 for r in got)


def components(rows, n, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    at = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    at[i] = at[j] = min(at[i], at[j])
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[at[i]] = min(least.get(at[i], r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(at[i]) if sets[i] else r.doc_id) for i, r in enumerate(rows))


@pytest.mark.parametrize("n, percent, most", [(3, 90, 4000), (5, 80, 4000), (5, 80, 2)])
def test_jaccard(docs, none, n, percent, most):
    got = jaccard.jaccard_components(docs, n, percent, cluster_sets_=most)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == components(docs.collect(), n, percent)
    if most > 2:
        assert jaccard.jaccard_components(none, n, percent).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_one_per_group(docs, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
    kept = jaccard.one_per_group(docs)
    want = components(docs.collect(), 5, 80)
    groups = {c for _, n, c in want if n}
    blank = sum(1 for r in docs.collect() if not WORD.findall(r.text or ""))
    assert kept.columns == docs.columns and kept.count() == len(groups) + blank


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld  text,\n with words.<p>Second &lt;one&gt;.<br>Line</article><div class=\"comments\"><p>Nice article, thanks a lot.</p></div><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<<p", "x"), (1, page, "x")], "page_id long, html string, text string")
    got = html_text.extract(df).collect()
    assert got[0].text == got[4].text == "Title & more First bold text, with words. Second <one>. Line"
    assert got[1].text == got[2].text == ""
    assert html_text.extract(df.where("false")).count() == 0
    model = html_text.trained()
    right = 0
    for h, mark in html_text.synthetic_pages(100, 77):
        nodes = html_text.measured(html_text.parse(h))
        words = html_text.main_text(nodes[0], html_text.decode(nodes, model.logit(html_text.features(nodes)))).split()
        right += all(mark in w for w in words) and len(words) == len(re.findall(mark, h))
    assert right >= 90


@pytest.mark.parametrize("page, text", [
    ("<article><h1>Head</h1><p title=don't>Hello brave new world.</p><p>It's the second paragraph.</p></article>", "Head Hello brave new world. It's the second paragraph."),
    ("<article><h1>Head</h1><p data-x='>lost text here</p><p>More of it, and more.</p></article>", "Head lost text here More of it, and more."),
    ('<article><h1>Head</h1><p>One two <span style="display:none">HIDDEN</span>three <span class="advert sponsored">BUY NOW</span> four <span class="hl">five</span>six.</p></article>', "Head One two three four fivesix."),
    ("<article><h1>Head</h1><p>If <math><mi>x</mi></math> is here, it is text.</p></article>", "Head If x is here, it is text."),
    ("<article><p>a<template><p>no</p></template>b</p><svg><text>no</text></svg><p>c <select><option>no</option></select></p></article>", "a b c"),
    ('<article><p>1 < 2 and a<b c</p><p class="x" hidden>no</p><p>yes</p></article>', "1 < 2 and a yes"),
    ("<article><p>x<!-- no --> y<script>no</script>&amp;&#x41;&eacute;</p></article>", "x y &Aé"),
])
def test_html_markup(page, text):
    assert html_text.texts_of([page], html_text.trained()) == [text]


@pytest.mark.parametrize("piece", ["<div>", '<p a="', "<svg>", "<noscript>", "<x><center>", "<p a='", "<b class=x>", "</i>", "<", "<!--", "&amp;"])
def test_html_takes_linear_time(piece):
    import time

    html_text.trained()
    began = time.process_time()
    html_text.texts_of([piece * 20_000 + "</i>" * 20_000], html_text.trained())
    assert time.process_time() - began < 8


def test_html_of_pages(spark, sf):
    """The article of each page of the table, cut out by its tags alone."""
    import html

    for r in html_text.op4_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\0", inside)).split("\0")
        want = " ".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))
        assert (r.text, r.n_chars) == (want, len(want))


def counted(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def least(values, share):
    return sorted(values)[max(0, int(np.ceil(share * len(values))) - 1)]


def estimates(groups, up, prior=None):
    """The regularized MCD of ``quality.estimate`` for all groups {name: rows x statistics}, in numpy."""
    p, floors, k = len(quality.STATS), np.diag([quality.FLOOR[s] ** 2 for s in quality.STATS]), quality.PRIOR

    def regular(g, m, c, n):
        if prior:
            m, c = (n * m + k * prior[up[g]][0]) / (n + k), (n * c + k * prior[up[g]][1]) / (n + k)
        return m, c + floors

    def moments(x):
        return x.mean(0), np.atleast_2d(np.cov(x.T, bias=True)) if len(x) > 1 else np.zeros((p, p))

    def far(x, at):
        return np.einsum("ij,ij->i", (x - at[0]) @ np.linalg.inv(at[1]), x - at[0])

    now = {}
    for g, x in groups.items():
        med = np.array([least(c, 0.5) for c in x.T])
        mad = np.array([least(abs(c - m), 0.5) for c, m in zip(x.T, med, strict=True)])
        now[g, 0] = regular(g, med, np.diag((1.4826 * mad) ** 2), len(x))
        now[g, 1] = regular(g, *moments(x), len(x))
    logdet = lambda at: np.linalg.slogdet(at[1])[1]
    for _ in range(quality.STEPS):
        was = {key: logdet(at) for key, at in now.items()}
        for (g, s), at in now.items():
            d = far(groups[g], at)
            core = groups[g][d <= least(d, quality.CORE)]
            now[g, s] = regular(g, *moments(core), len(core))
        if not any(logdet(at) < was[key] - quality.TOLERANCE for key, at in now.items()):
            break
    out = {}
    for g, x in groups.items():
        m, c = min((now[g, s] for s in (0, 1)), key=logdet)
        own = max(1.0, least(far(x, (m, c)), 0.5) / quality.CHI2_MEDIAN[p])
        scale = np.exp((len(x) * np.log(own) + k * np.log(prior[up[g]][2])) / (len(x) + k)) if prior else own
        out[g] = m, c, scale
    return out, far


def judged(rows):
    """Verdicts of rows with lang, source, base_failed and statistics, in numpy."""
    stats = lambda own: np.array([[getattr(r, s) for s in quality.STATS] for r in own])
    good = [r for r in rows if not r.base_failed]
    names = {(r.lang, r.source) for r in good}
    langs, far = estimates({x: stats([r for r in good if r.lang == x]) for x, _ in names}, None)
    fitted, _ = estimates({n: stats([r for r in good if (r.lang, r.source) == n]) for n in names}, {n: n[0] for n in names}, langs)
    out = {(r.lang, r.source): 0.0 for r in rows}
    for r in rows:
        at = fitted.get((r.lang, r.source))
        far_off = far(stats([r]), at)[0] / at[2] if at else 0.0
        yield r, far_off, not r.base_failed and far_off <= quality.CUT


@pytest.mark.parametrize("few", [20_000, 0])
def test_quality(spark, sf, docs, none, monkeypatch, few):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", few)
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality.quality(df, ("doc_id", "lang", "source", "text")).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(r.text)
        for r, far_off, kept in judged(got):
            assert abs(r.outlyingness - far_off) < 1e-6 * max(1, far_off) and r.kept == kept
        stay = quality.accepted(df)
        assert stay.columns == df.columns and rows_of(stay.select("doc_id", "text")) == Counter((r.doc_id, r.text) for r in got if r.kept)
    assert quality.quality(none).count() == quality.accepted(none).count() == 0


def test_quality_outliers(spark):
    n = F.col("id")
    text = F.array_join(F.transform(F.sequence(F.lit(0), 40 + n % 60), lambda i: F.concat(F.when(n % 50 == 7, F.lit("## ")).otherwise(F.lit("")), F.substring(F.md5((n * 1000 + i).cast("string")), F.lit(1), (3 + (n * 7 + i) % 6).cast("int")))), " ")
    d = spark.range(600).select(n.alias("doc_id"), F.lit("en").alias("lang"), F.when(n % 3 == 0, "a").otherwise("b").alias("source"), text.alias("text"))
    assert {r.doc_id for r in quality.quality(d).collect() if not r.kept} == {i for i in range(600) if i % 50 == 7}


@pytest.mark.parametrize("small", [1_000, 2, 0])
def test_chat(spark, monkeypatch, small):
    monkeypatch.setattr(chat, "SMALL_TREE", small)  # trees met by name, by node, or both
    monkeypatch.setattr(chat, "BROADCAST_TREES", 0 if small == 2 else 100_000)
    odd = "<|im_end|><|im_start|>assistant ok &lt;| & <"
    rows = [(1, 0, None, "user", odd, 0.0), (1, 1, 0, "assistant", "A\n1", 1.0), (1, 2, 0, "assistant", None, 2.0), (1, 3, 1, "us\ner&", "", 5.0),
            (2, 0, 9, None, "orphan", None), (3, 0, 1, "user", "cycle", 0.0), (3, 1, 0, "user", "cycle", 0.0), (3, 2, 0, "assistant", "on it", 0.0), (None, 0, None, "assistant", odd, 0.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.chat_format(nodes).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    back = {k: [tuple(t) for t in r.back] for k, r in got.items()}
    assert back == {(1, 3): [("user", odd), ("assistant", "A\n1"), ("us\ner&", "")], (1, 2): [("user", odd), ("assistant", "")], (2, 0): [("", "orphan")], (None, 0): [("assistant", odd)]}
    assert (got[1, 3].rank, got[1, 2].rank, got[1, 3].loss, got[None, 0].loss) == (1, 2, "A\n1", odd)
    assert chat.chat_format(nodes, top=1).where("tree = 1").select("leaf").collect()[0][0] == 3
    assert chat.chat_format(nodes.where("false")).count() == 0
    again = nodes.unionByName(nodes).unionByName(spark.createDataFrame([(1, None, 0, "user", "no name", 9.0)], nodes.schema))
    for top in (None, 5):
        assert {(r.tree, r.leaf): (r.n_turns, r.formatted, r.rank, r.branch_score) for r in chat.chat_format(again, top).collect()} == {k: (r.n_turns, r.formatted, r.rank, r.branch_score) for k, r in got.items()}


def test_fingerprints(spark, docs, none):
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for parts in (1, 5):
        got = fingerprints.with_next(d.withColumn("sk", fingerprints.sketch(F.col("text"))), "doc_id", ["text", "sk"], parts).orderBy("doc_id").collect()
        texts = [r.text for r in got]
        assert [r.next_text for r in got] == texts[1:] + texts[:1]
    x = F.col("sk")
    s = d.withColumn("sk", fingerprints.sketch(F.col("text"))).withColumn("back", fingerprints.decoded(fingerprints.encoded(x)))
    assert s.where(~(F.col("back") == x)).count() == 0
    by = {r.text: r.sk for r in s.collect()}
    pair = spark.createDataFrame([(by[BASE], by[BASE + " tail"]), (by[""], by[" \n\t "]), (by[""], by["one"])], "a array<long>, b array<long>")
    j = [r[0] for r in pair.select(fingerprints.resemblance(F.col("a"), F.col("b"))).collect()]
    assert j == [56 / 57, 1.0, 0.0]
    r = pair.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_count(F.col("a"))).first()
    assert abs(r[0] - 1.0) < 1e-9 and r[1] == 56
    whole = fingerprints.merged(s.withColumn("g", F.lit(1)), ["g"], "sk").first()["sk"]
    assert whole == sorted(set().union(*map(set, by.values())))[: fingerprints.K]
    big = spark.range(1).select(fingerprints.sketch(F.array_join(F.sequence(F.lit(1), F.lit(5004)), " ")).alias("a"))
    assert abs(big.select(fingerprints.distinct_count(F.col("a"))).first()[0] - 5000) < 1500
    assert fingerprints.with_next(none.select("doc_id", "text"), "doc_id", ["text"], 1).count() == 0


def test_fingerprints_of_documents(spark, sf):
    """Edited texts, their hashes, exact likenesses where sketches hold all shingles, and the error of the others."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)

    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    def like(a, b):
        return len(a & b) / len(a | b) if a and b else float(not a and not b)

    errors, by_text = [], {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        for mine, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(abs(mine - like(a, b)))
            if len(a | b) <= fingerprints.K:
                assert errors[-1] < 1e-9
    assert np.mean(errors) < 0.02 and max(errors) < 0.2


def test_next_row(spark, docs):
    rows = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(spark.createDataFrame([(None, "null id")], "doc_id long, text string"))
    for df in (rows, rows.select(F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("doc_id"), "text"), rows.select(F.col("doc_id").cast("double"), "text")):
        want = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first()).collect()]
        for parts in (1, 4):
            got = fingerprints.with_next(df.withColumn("range", F.lit(1)).withColumn("next_text", F.lit(0)), "doc_id", ["text"], parts, {"n": F.length("text")}).orderBy(F.col("doc_id").asc_nulls_first()).collect()
            assert [(r.doc_id, r.text, r.next_text, r.next_n) for r in got] == [(*w, after[1], None if after[1] is None else len(after[1])) for w, after in zip(want, want[1:] + want[:1], strict=True)]
    assert fingerprints.with_next(docs.limit(1), "doc_id", ["text"], 3).count() == 1
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "doc_id long, text string")
    assert [r.next_text for r in fingerprints.with_next(tied, "doc_id", ["text"], 3).orderBy("doc_id", "text", "next_text").collect()] == ["a", "b", "c", "a"]


def test_toxicity(spark, docs, none):
    r = np.random.default_rng(1)
    bad = ["vile", "foul", "rotten"]
    make = lambda t: " ".join([*(f"n{k}" for k in r.integers(0, 400, 40)), *([bad[r.integers(3)]] if t else []), *(f"n{k}" for k in r.integers(0, 400, 10))])
    y = [int(k % 5 == 0) for k in range(900)]
    texts = [make(t) for t in y]
    model = toxicity.train(texts[:600], y[:600], ["en"] * 600)
    seen = toxicity.Buckets()
    s = model.score([toxicity.word_ids(t, seen) for t in texts[600:]])
    assert ((s >= 0.7) == (np.array(y[600:]) == 1)).mean() > 0.97
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= g.score <= 1 for g in got)
    assert got[0].score == got[1].score == got[2].score and got[0].text is None
    assert toxicity.toxicity(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = toxicity.train(*toxicity.training_rows(docs, labels))
    assert all(g.score < 0.01 for g in toxicity.toxicity(docs, blank).collect())


def test_pipeline_drops_by_the_threshold_of_the_language(spark, docs, monkeypatch, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train([], [], [])
    model.ob, model.thresholds = np.float32(np.log(0.6 / 0.4)), {"de": 0.55, "en": 0.65}  # every score is 0.6
    monkeypatch.setattr(toxicity, "train", lambda *rows: model)
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert rows_of(got.select("doc_id", "lang")) == rows_of(docs.where("lang is null or lang <> 'de'").select("doc_id", "lang"))


def test_lm_scores(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    got = lm_scores.lm_scores(docs, path, held).collect()
    rows = docs.collect()
    words = lambda t: [*WORD.findall((t or "").translate(LOWER)), " "]
    c = Counter(w for r in rows if not (r.doc_id or 0) % 3 == 1 for w in words(r.text))
    total, distinct = sum(c.values()), len(c)
    base = lambda t: float(sum(np.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words(t)))
    want = Counter((r.doc_id, (r.doc_id or 0) % 3 == 1, len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), total, round(base(r.text), 4)) for r in rows)
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got) == want
    assert all(np.isfinite(g.score) and g.score < 0 for g in got)
    assert lm_scores.lm_scores(none, path, held).count() == 0
    unlearnt = lm_scores.lm_scores(docs, path, F.lit(True)).collect()
    assert len(unlearnt) == len(rows) and all(g.train_tokens == g.n_known == 0 and abs(g.score - g.base_score) < 1e-6 for g in unlearnt)


def test_subwords(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # as ordinary text
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in lm_scores.words(r.text)} | {w for x in TEXTS for w in lm_scores.words(x)} | {b"\xff\xfe", b"\xed\xa0\x80"})
    assert lm_scores.subwords(path, words) == [t.encode(" " + w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]


def test_lm_scores_learns_from_every_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = {k: " ".join(f"{'abcdefgh'[(i * i + k) % 8]}{k}" for i in range(90)) for k in range(5)}
    df = lambda texts: spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(2, "doc_id")

    def held_out_score(texts):
        (r,) = lm_scores.lm_scores(df(texts), path, F.col("doc_id") == 4).where("held_out").collect()
        return r.base_score, r.score

    base, score = held_out_score(text)
    for k in range(4):  # the same counts in another order
        other = held_out_score(text | {k: " ".join(sorted(text[k].split()))})
        assert other[0] == base and other[1] != score
    gathered = lm_scores.gather(df(text | {5: None}), path, F.col("doc_id") == 4)
    classes = lm_scores.class_table(lm_scores.counts(gathered)[0][:-1])
    assert lm_scores.learn_all(gathered, classes)["learnt"] == 4 * 91 + 1


def test_lm_scores_beat_the_base_on_held_out_texts(spark):
    words = lambda k, lang: " ".join(f"{lang}{(k * 7919 + i * i * 31) % 40}" for i in range(200))
    d = spark.createDataFrame([(k, words(k, "ab"[k % 2])) for k in range(400)], "doc_id long, text string")
    r = lm_scores.lm_scores(d, public_tokenizers.path("byte_bpe_50k.json"), F.col("doc_id") % 5 == 1).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (r[1] - r[0]) / r[2] > 0.1


def brute_scores(net, bags, words, lengths):
    """Place by place: every product written out for one place at a time, in its window."""
    p, out, at = net.p, [], 0
    vec = [p["start"]] + [p["emb"][bags.ids[s : s + n]].mean(0) for s, n in zip(bags.starts, bags.sizes, strict=True)]
    for n in lengths:
        own = words[at : at + n]
        at += n
        for k in range(n):
            j = 0 if k < attention.WINDOW else -(-(k + 1 - attention.WINDOW) // attention.STRIDE)
            first = j * attention.STRIDE
            seen = [vec[0] if q == 0 else vec[own[q - 1]] for q in range(first, k + 1)]
            a = np.array([float(seen[-1] @ p["qk"] @ s) + p["place"][len(seen) - 1 - i] for i, s in enumerate(seen)])
            a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
            h = np.maximum(0, seen[-1] @ p["own"] + sum(w * s for w, s in zip(a, seen, strict=True)) @ p["seen"] + p["b"])
            z = h @ p["out"] + p["bo"]
            out.append(z[bags.classes[own[k]]] - z.max() - np.log(np.exp(z - z.max()).sum()))
    return np.array(out)


def test_attention_against_single_places():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 4, 50)
    bags = attention.Bags(r.integers(0, 300, sizes.sum()), sizes, r.integers(0, attention.CLASSES, 50))
    net = attention.Attention(3, 300)
    lengths = np.array([1, 5, 31, 32, 33, 60, 61, 130])
    words = r.integers(1, 51, lengths.sum())
    trainer = attention.Trainer(net, 0.02)
    trainer.texts(bags, words, lengths, r)
    assert trainer.places == lengths.sum()
    assert np.allclose(net.scores(bags, words, lengths), brute_scores(net, bags, words, lengths), atol=1e-4)


def test_attention_gradients():
    r = np.random.default_rng(4)
    net = attention.Attention(1, 10)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.standard_normal((2, attention.WINDOW, attention.DIM))
    real = np.ones((2, attention.WINDOW), bool)
    real[1, 20:] = False
    target = r.integers(0, attention.CLASSES, real.shape)

    def loss(x):
        c = net.look(x, x @ net.p["qk"])[2]
        z = net.logits(net.hidden(x[real] @ net.p["own"], c[real] @ net.p["seen"], net.p["b"]))
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), target[real]]).mean())

    trainer = attention.Trainer(net, 0.0)
    g = trainer.batch(x.copy(), real, target)
    for at in [(0, 0, 0), (0, 5, 3), (1, 19, 7), (1, 2, 1)]:
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-6


def test_windows_score_each_place_once():
    for n in (1, 2, 31, 32, 33, 59, 60, 61, 100, 1000):
        place, real, scored = attention.grid(np.array([3, n, 2]), attention.STRIDE)
        assert Counter(place[scored].tolist()) == Counter(range(n + 5))
        assert (place[scored & real] == place[scored]).all() and (scored.argmax(1)[scored.any(1)] <= attention.WINDOW - attention.STRIDE).all()


def test_digests():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and zlib.crc32(b"7") % 3 in (0, 1, 2)


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(percent)
    for _ in range(1500):
        size = int(np.exp(rng.uniform(0, 7)))
        gone, new = rng.integers(0, size, 2)
        while 100 * (size - gone) < percent * (size + new):
            gone, new = int(gone * 0.9), int(new * 0.9)
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        assert len(np.intersect1d(jaccard.signatures(np.unique(a), bands), jaccard.signatures(np.unique(b), bands)))


def test_components_of_a_chain(spark):
    from winnowry.llm.components import components

    n = 300
    chain = spark.range(n - 1).select((F.col("id") * 3).alias("a"), (F.col("id") * 3 + 3).alias("b"))
    ring = spark.range(20).select((10_000 + F.col("id")).alias("a"), (10_000 + (F.col("id") + 1) % 20).alias("b"))
    odd = spark.createDataFrame([(50_000, 50_000), (60_000, 60_001), (60_001, 60_000), (None, 5)], "a long, b long")
    got = {}
    for r in components(chain.unionByName(ring).unionByName(odd)).collect():
        got.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(len, got.values())) == [2, 20, n] and all(c in own for c, own in got.items())


def test_steady(spark, docs, tmp_path):
    from winnowry.llm.common import steady

    docs.write.parquet(f"{tmp_path}/d")
    scan = spark.read.parquet(f"{tmp_path}/d").select("doc_id", F.upper("text").alias("text")).where("doc_id > 3")
    assert steady(scan) is scan
    mixed = scan.repartition(3)
    assert steady(mixed) is not mixed and rows_of(steady(mixed)) == rows_of(scan)


# the pipeline, stage by stage ------------------------------------------------


def least_hash_rows(docs, labels):
    """Texts, labels and languages that toxicity learns from, in its order."""
    toxic = {}
    for r in labels:
        if r.toxic is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    first = lambda c: (c is not None, c or "")
    by = {}
    for r in docs:
        if r.doc_id in toxic:
            by[r.doc_id] = min(by.get(r.doc_id, r), r, key=lambda x: (first(x.text), first(x.lang)))
    own = sorted(by.values(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text or ""))
    return [r.text for r in own], [int(toxic[r.doc_id] > 0) for r in own], [r.lang for r in own]


def brute_toxicity(docs, labels):
    model = toxicity.train(*least_hash_rows(docs, labels))
    seen = toxicity.Buckets()
    scores = [float(model.score([toxicity.word_ids(r.text, seen)])[0]) for r in docs]
    limits = [model.thresholds.get(r.lang, 0.7) for r in docs]
    assert all(abs(s - t) > 1e-5 for s, t in zip(scores, limits, strict=True))
    return [r for r, s, t in zip(docs, scores, limits, strict=True) if s < t]


def brute_quality(spark, docs, schema):
    rows = quality.quality(spark.createDataFrame(docs, schema), ("doc_id", "lang", "source", "text")).collect()  # the statistics have a test of their own
    kept = Counter((r.doc_id, r.text) for r, _, k in judged(rows) if k)
    return [r for r in docs if kept[r.doc_id, r.text]]


def brute_one_per_group(docs):
    sets = []
    for r in docs:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    at = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if at[i] != at[j] and a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
                    changed = True
    first = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((str(r.doc_id) if r.doc_id is not None else "\0").encode() + b"\1" + (r.text if r.text is not None else "\0").encode()).digest())
    best = {}
    for x, r, s in zip(at, docs, sets, strict=True):
        if s:
            best[x] = min(best.get(x, r), r, key=first)
    return [r for r, s in zip(docs, sets, strict=True) if not s] + list(best.values())


def brute_mix(spark, docs, schema):
    df = spark.createDataFrame(docs, schema)
    found = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", mixing.hashed("doc_id", "text", 17).alias("h")).collect()}
    rows = [(r.source, found[r.doc_id, r.text], len(WORD.findall(r.text or ""))) for r in docs]
    goals = {r.source: (r.source_size, r.target) for r in mixing.mix(df).select("source", "source_size", "target").distinct().collect()}  # water filling has a test of its own
    copies = {k[:3]: k[3] for k in taken_by(rows, goals)}
    return [r for r, key in zip(docs, rows, strict=True) for _ in range(copies[key])]


def test_pipeline(spark, sf, docs, none, tmp_path):
    from tokenizers import Tokenizer

    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), *[F.lit(c).alias(c) for c in CLASHES])
    whole = whole.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    whole.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").collect()
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    steps = [lambda d: brute_toxicity(d, labels), lambda d: brute_quality(spark, d, whole.schema), brute_one_per_group, lambda d: brute_mix(spark, d, whole.schema)]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        now, want = corpus_pipeline.materialise(stage(spark, now, str(tmp_path))), brute(want)
        assert now.schema == whole.schema and rows_of(now) == Counter(map(tuple, want))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = Counter()
    for r in want:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        coded[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == coded
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == whole.count()  # the table itself stays


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
