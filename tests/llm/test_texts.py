"""Operators that look at one text: against plain Python, on edge rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, elias_fano, gbt, licenses, packing, quality, secrets, toxicity, url_filter

from .helpers import SCHEMA, docs, edge_docs, lowered

GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_words(text):
    return GAP.findall(lowered(text).decode())


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_counts_equal_plain_python(spark):
    def plain(text):
        words = (text or "").encode().split()
        hit, seen = set(), {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                hit |= {p + k for p in places for k in range(8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(hit), failed

    rules = quality.QualityRules(gbt.fit(np.zeros((0, 12)), np.zeros(0)))
    rows = [*edge_docs(), (99, "a b #\na b #\n \n" * 3, "", "", 0, 0.0, "")]
    found = quality.judge(docs(spark, rows), rules)
    assert by_row(found, "doc_id", *quality.COUNTS, "base_failed") == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    assert found.where("kept = base_failed").count() == 0
    assert quality.judge(docs(spark, []), rules).count() == 0


def test_trees_learn_and_keep_their_constraints():
    dice = np.random.default_rng(0)
    x = dice.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    forest = gbt.fit(x, y, trees=60, depth=3)
    assert ((gbt.sigmoid(forest.margin(x)) > 0.5) == y).mean() > 0.97
    rising = gbt.fit(x, y, trees=40, depth=3, monotone={0: 1})
    grid = np.tile(dice.random((50, 1, 3)), (1, 40, 1))
    grid[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(rising.margin(grid.reshape(-1, 3)).reshape(50, 40), axis=1) >= -1e-9).all()
    assert len(gbt.fit(x, np.ones(3000)).feature) == 0 and gbt.fit(x[:0], y[:0]).margin(x[:2]).shape == (2,)


def test_isotonic_is_monotone_and_pools_ties():
    xs, ys = gbt.isotonic(np.array([1.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and gbt.calibrated(np.array([1.0]), (xs, ys))[0] == pytest.approx(1 / 3)


def test_toxicity_finds_held_out_rows_and_never_reads_their_labels(spark):
    texts = [f"plain words number {i} {'you pathetic idiot' if i % 3 == 0 else 'a fine day'} end" for i in range(240)]
    rows = [(i, t, "en", "s", len(t), 0.0, "") for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None), (7, "", None, None, 0, None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    own = docs(spark, rows)
    found = toxicity.score(own, toxicity.train(own, labels)).collect()
    assert len(found) == 242 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert by_row(toxicity.score(own, toxicity.train(own, flipped)), "doc_id", "score") == sorted(((r.doc_id, r.score) for r in found), key=repr)
    none = toxicity.score(own, toxicity.train(own, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]


def test_secrets_keep_the_base_spans_and_follow_names(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(text):
        text = text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))

    rows = [*edge_docs(), (50, "token=secret:abcdefgh1234 AKIAAKIA1234567890 token=token=abcdefghij", "", "", 0, 0.0, "")]
    found = secrets.find_secrets(docs(spark, rows))
    assert by_row(found, "doc_id", "base_sha256") == sorted(((r[0], hashlib.sha256(base(r[1]).encode()).hexdigest()) for r in rows), key=repr)
    text = 'raw = "zX9$kQ2vLm8T"\napi_secret = raw\nname = "hello world"\n'
    spans = secrets.scan(text)
    assert [(text[a:b], k) for a, b, k in spans] == [("zX9$kQ2vLm8T", "literal")]
    assert "zX9$" not in secrets.redact(text) and secrets.redact(None) is None
    assert secrets.find_secrets(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "my_secret" + " " * 20 + '= "zX9$kQ2vLm8T"', "a" * 140 + '_token = "zX9$kQ2vLm8T"', 'db_password = "zX9$k\\"Q2vLm8T"', 'api_secret = raw\nraw = "zX9$kQ2vLm8T"', "secret_key: |\n  zX9$kQ2vLm8T\nother: 1",
        'auth_token = """zX9$kQ2vLm8T"""', 'client_secret = f"zX9$k" + "Q2vLm8T"', '"' + "k" * 130 + 'Password": "zX9$kQ2vLm8T"', 'c = b\nb = a\na = "zX9$kQ2vLm8T"\nuser_password = c',
    ],
)
def test_literals_of_sensitive_names(text):
    spans = [text[a:b] for a, b, k in secrets.scan(text) if k == "literal"]
    assert len(spans) == 1 and spans[0].startswith("zX9$k") and spans[0].endswith("Q2vLm8T")
    assert "Q2vLm8T" not in secrets.redact(text)


def test_origins_equal_a_slow_walk():
    import random

    dice = random.Random(3)
    for _ in range(300):
        names = [dice.choice("abcdef") for _ in range(dice.randrange(1, 12))]
        pairs = [(n, *((dice.choice("abcdefg"), 0, 1, True) if dice.random() < 0.7 else ("lit", 0, 1, False))) for n in names]

        def step(i, pairs=pairs):
            same = [j for j, p in enumerate(pairs) if p[0] == pairs[i][1] and j != i] if pairs[i][4] else []
            return max((j for j in same if j < i), default=min(same, default=i))

        for i, end in enumerate(secrets.origins(pairs)):
            seen, at = [], i
            while at not in seen:
                seen.append(at)
                at = step(at)
            assert end in seen[seen.index(at) :]  # the end, or any pair of the loop


def test_secrets_take_time_in_proportion():
    import time

    for text in ('"' + '\\"' * 200_000, "a" * 400_000 + " " * 400_000, "x=" * 200_000, "'" * 400_000, 'a = """' * 50_000):
        began = time.time()
        secrets.literals(text, 0.45)
        assert time.time() - began < 20


def test_stages_take_any_columns(spark, tmp_path):
    import math

    rows = [(r[0], r[1], 1, "x", 2.0, "y") for r in edge_docs()]
    own = spark.createDataFrame(rows, "doc_id long, text string, _new int, TEXT string, _key double, new string")
    base = edge_docs()[0][1].split()
    spark.createDataFrame([(1, " ".join(base[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    def texts(df):
        assert df.columns == own.columns
        return sorted(((r[0], r[1]) for r in df.collect()), key=repr)

    def plain(keep, change=lambda t: t):
        return sorted(((r[0], change(r[1])) for r in rows if keep(r[1])), key=repr)

    def failed(text):
        n, hit = len((text or "").encode().split()), quality.statistics(text or "")[0][4]
        return n < 20 or 100 * hit > 30 * n

    wanted = ascii_words(" ".join(base[10:30]))
    windows = {tuple(wanted[i : i + 10]) for i in range(11)}
    leaks = lambda t: any(tuple(ascii_words(t)[i : i + 10]) in windows for i in range(len(ascii_words(t))))
    assert texts(quality.quality_stage(spark, own, str(tmp_path))) == plain(lambda t: not failed(t))
    assert texts(decontaminate.decontamination_stage(spark, own, str(tmp_path))) == plain(lambda t: not leaks(t))
    assert texts(secrets.redaction_stage(spark, own, str(tmp_path))) == plain(lambda t: True, secrets.redact)
    for stage in (quality.quality_stage, decontaminate.decontamination_stage, secrets.redaction_stage):
        assert stage(spark, own.limit(0), str(tmp_path)).count() == 0
    pieces = packing.packing_stage(spark, own, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == len({r[0] for r in rows}) and math.log2(pieces.agg(F.sum("length")).first()[0]) > 1


def test_pipeline_equals_its_stages_on_plain_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    base = edge_docs()[13][1].split()
    spark.createDataFrame([(1, " ".join(base[5:15]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    # kept by the base rule: long texts without repeats; of 0, 1, 2, 3 and the rows without an id or with id 0 again one stays; 13 holds the benchmark item
    kept = {r.doc_id for r in found.collect()}
    long = {r[0] for r in edge_docs() if not (lambda s: s[0] < 20 or 100 * s[4] > 30 * s[0])(quality.statistics(r[1] or "")[0])}
    assert kept == {i for i in long if i not in (1, 2, 3, 13, None)}


def test_urls_by_digest_equal_plain_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net", "http://badexample.net/en/", "https://x.org/fr", "https://x.org/fr/#a/b", "ftp://net/", "http://example.com/de/?q", "a://b://c.net/", "http://example.com?/de/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lowered(host).decode()
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    found = url_filter.judge_urls(pages, url_filter.RULES)
    assert by_row(found, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *plain(u)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(pages.limit(0), []).count() == 0
    longer = url_filter.DigestArray([url_filter.Rule("x.net/", "block"), url_filter.Rule("net/abc/d", "allow")])
    assert longer.judge(["http://x.net/abc/d", "http://x.net/abc"], "allow")["rule"] == ["net/abc/d", "x.net/"]
    clash = url_filter.DigestArray(url_filter.RULES)
    original = url_filter.digest
    try:
        url_filter.digest = lambda host, path: 7  # every key collides: only full strings decide
        clash = url_filter.DigestArray(url_filter.RULES)
        assert clash.judge(["http://a.example.net/en/"], "allow")["rule"] == ["example.net/en/"]
        assert clash.judge(["http://a.example.xyz/en/"], "allow")["rule"] == [None]
    finally:
        url_filter.digest = original


@pytest.mark.parametrize("few", [True, False])
def test_contamination_equals_plain_windows(spark, few):
    rows = edge_docs()
    base = rows[0][1].split()
    items = [(1, " ".join(base[10:30])), (2, "Solo!"), (3, None), (4, "..."), (None, " ".join(base[200:212])), (5, "x " + " ".join(base[60:71])), (1, " ".join(base[10:30])), (6, "one two three")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, window int")

    def plain(text):
        w = ascii_words(text)
        hit, ids = set(), set()
        for item, t in items:
            b = ascii_words(t)
            for s in range(max(1, len(b) - 9)) if b else ():
                win = b[s : s + 10]
                at = [i for i in range(len(w) - len(win) + 1) if w[i : i + len(win)] == win]
                hit |= {i + k for i in at for k in range(len(win))}
                if at and item is not None:
                    ids.add(str(item))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    found = decontaminate.contamination(docs(spark), bench, broadcast_rows=10**6 if few else 0)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(found, *columns) == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    wide = spark.createDataFrame([(1, " ".join(base[10:90]))], "item_id long, text string")
    assert decontaminate.contamination(docs(spark), wide, window=30, broadcast_rows=10**6 if few else 0).agg(F.sum("n_hit")).first()[0] == 5 * 80 + 79  # one text has another word in the middle
    assert decontaminate.contamination(docs(spark), bench.limit(0)).where("contaminated").count() == 0


def test_licenses_equal_plain_phrases(spark):
    rows = [*edge_docs(), (60, "cc by nc cc by nc. Under the MIT license", "", "", 0, 0.0, "")]

    def plain(text):
        w, places, labels = ascii_words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    found = licenses.scan(docs(spark, rows))
    assert by_row(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    grant = licenses.TEMPLATES["mit"].replace("any person", "any kind person")
    one = licenses.scan(docs(spark, [(1, "x " + grant, "", "", 0, 0.0, ""), (2, " ".join(grant.split()[:9]), "", "", 0, 0.0, "")])).orderBy("doc_id").collect()
    assert [r.labels for r in one] == ["mit", ""] and 0 < one[1].score < 0.6 <= one[0].score
    assert licenses.scan(docs(spark, [])).count() == 0
    turned = " ".join(licenses.TEMPLATES["gpl"].split()[i] for k in range(0, 28, 4) for i in range(24 - k, 28 - k))  # the same k-grams in another order
    assert [r.labels for r in licenses.scan(docs(spark, [(1, turned, "", "", 0, 0.0, "")])).collect()] == [""]


def test_packing_is_a_round_trip_without_padding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rows = [(i, r[1], *r[2:]) for i, r in enumerate([*edge_docs(), (0, "a  b   c \n\n d\u00a0e f\x1c g <|endoftext|> it's  ", "", "", 0, 0.0, "")])]
    path = packing.default_tokenizer()
    plain = tokenizers.Tokenizer.from_file(path)
    ids = {r[0]: np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    found = packing.pack(docs(spark, rows).repartition(3), path).toPandas()
    for doc, pieces in found.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc]) and p.ids_crc32 == zlib.crc32(ids[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    assert set(found["doc_id"]) == set(ids)
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        total = s["length"].sum()
        assert total <= 1024 and total & (total - 1) == 0 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert packing.pack(docs(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), path, tiers=(100,))


def test_token_ids_equal_the_library(spark):
    import random

    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    plain, own, dice = tokenizers.Tokenizer.from_file(path), packing.Encoder(path), random.Random(4)
    parts = [*own._added, "<|endoftext|", "<|", "|>", "  ", " ", "\n", "a", " word", "It's", "\u00e9", "\U0001f600", "12", "<", "\u2003", "...", "\t"]
    for _ in range(6000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(1, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("universe", [1, 50, 10**6, 1 << 63])
def test_elias_fano_searches(universe):
    dice = np.random.default_rng(universe % 97)
    values = np.sort(dice.integers(0, universe, 500, dtype=np.uint64))
    ef = elias_fano.EliasFano(values, universe)
    assert (ef.get(np.arange(500)) == values).all()
    keys = np.r_[values, dice.integers(0, universe, 500, dtype=np.uint64)]
    assert (ef.successor(keys) == np.searchsorted(values, keys)).all()
    assert ((ef.find(keys) >= 0) == np.isin(keys, values)).all()
    assert elias_fano.EliasFano(values[:0], universe).find(keys).max() == -1
    assert SCHEMA
