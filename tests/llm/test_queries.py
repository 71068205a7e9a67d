"""The registered queries on small tables with nulls, repeats and odd texts, and each operator against a plain form of itself."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from typeloom.llm import compressor, langid, mixing, pii, quality_rules, toxicity
from typeloom.llm.common import unit_hash
from typeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMAS = {
    "op1_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_urlfilter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_pack": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_ngramjoin": "doc_id bigint, n_shingles bigint, component_id bigint",
}


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


TEXTS = None


def texts():
    global TEXTS
    if TEXTS is None:
        rng = random.Random(81)
        good = [prose(rng, rng.randint(60, 200), "aeiourst") for _ in range(120)]
        bad = [prose(rng, rng.randint(60, 200), "xqzjkw#%") + " zorgblat" * (i % 3) for i in range(80)]
        odd = [None, "", " \n\t", "one", "x" * 3000, "日本 — ünï", prose(rng, 30_000, "aeiourst"), "line " + prose(rng, 400, "aeiourst").replace(" ", "\n"), "1 2 3", good[0], good[0], "mail a@b.co or +1 547 555 0128"]
        TEXTS = good + bad + odd
    return TEXTS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "aa" if i < 120 else "bb" if i < 200 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id here", "aa", "s1", 3), (5, "other text of id five", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 120), int(i >= 120)) for i in range(200)] + [(7, 1, 0)] * 3 + [(8, None, None), (None, 1, 1), (9999, 1, 0), (10, 5, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.net/x", "h"), (1, "http://a.net/x", "h"), (None, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", SCHEMAS)
def test_queries_keep_their_contract(spark, folder, empty, name):
    df = QUERIES[name](spark, folder)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == SCHEMAS[name]
    rows = [r.asDict() for r in df.collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    if name not in ("op5_topk", "op7_urlfilter", "op8_pack"):
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in docs)
    for r in rows:
        if "held_out" in r:
            parts, left = (4, 2) if name == "op1_langid" else (3, 1)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == left)
        if "score" in r and name != "op5_topk":
            assert 0 <= r["score"] <= 1
        if name == "op2_toxicity":
            assert r["predicted"] == int(r["score"] >= 0.7)
        if name == "op9_quality":
            assert r["predicted"] == int(r["score"] >= 0.5)
    if name == "op5_topk":
        assert [tuple(r.values()) for r in rows] == [(0, 1, 1, 5242880), (0, 2, 2, 4194304)]
    if name == "op8_pack":
        held = defaultdict(list)
        for r in rows:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
    same = df.sparkSession.read.parquet(f"{folder}/documents.parquet")
    if name in ("op1_langid", "op2_toxicity", "op6_rules", "op9_quality"):  # rows of equal text are judged alike
        value = "lang_pred" if name == "op1_langid" else "kept" if name == "op6_rules" else "score"
        by = defaultdict(set)
        joined = same.where("doc_id IS NOT NULL AND doc_id <> 5").select("doc_id", "text").distinct().collect()
        text_of = {r.doc_id: r.text for r in joined}
        for r in rows:
            if r["doc_id"] in text_of:
                by[text_of[r["doc_id"]]].add(r[value])
        assert all(len(x) == 1 for x in by.values())
    nothing = QUERIES[name](spark, empty)
    assert nothing.dtypes == df.dtypes and nothing.count() == 0


def test_mix_takes_documents_in_the_order_of_a_plain_sort(spark):
    rng = random.Random(82)
    rows = [(i, prose(rng, rng.randint(0, 90)), rng.choice(["p", "p", "p", "q", None]), rng.choice([0.0, 0.01, 0.5, 1.0, None, 7.0])) for i in range(900)]
    rows += [(3, "tie tie", "p", 0.5), (3, "tie", "p", 0.5), (3, "tie", "p", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    u = {r.doc_id: r.u for r in docs.select("doc_id", unit_hash("doc_id", seed=20).alias("u")).collect()}
    of = defaultdict(list)
    for i, t, s, q in rows:
        w = mixing.LEAST_WEIGHT + (1 - mixing.LEAST_WEIGHT) * min(1.0, max(0.0, q or 0.0))
        of[s].append((-math.log(u[i]) / w, i, len(WORD.findall(t))))
    sizes = [(s, sum(x[2] for x in xs)) for s, xs in of.items()]
    aim = mixing.targets(sizes)
    want = []
    for s, xs in of.items():
        size = sum(x[2] for x in xs)
        epochs = int(aim[s] // size)
        left = math.floor(aim[s] - epochs * size)
        for _, i, n in sorted(xs):
            part = min(n, left)
            left -= part
            want.append((i, n, size, epochs * n + part))
    got = [(r.doc_id, r["size"], r.source_size, r.taken) for r in mixing.mix(docs, quality="q").collect()]
    assert sorted(got) == sorted(want)
    # A source of which a single weight and half the rows are hot is still spread over many bins.
    hot = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("hot").alias("source"), F.lit(0.0).alias("q"))
    key = -F.log(unit_hash("doc_id", seed=20)) / mixing.LEAST_WEIGHT
    assert hot.groupBy(F.floor(F.log2(key) * mixing.PER_OCTAVE)).count().agg(F.max("count")).first()[0] < 60


def test_toxicity_scores_as_word_by_word(spark, folder):
    rng = random.Random(83)
    sample = [(t, int("zorgblat" in t)) for t in texts()[:200]]
    model = toxicity.fit([t for t, _ in sample], np.array([y for _, y in sample]), 0.2)
    for t in [*(x for x in texts()[195:] if x and len(x) < 9000), "zorgblat " * 3 + prose(rng, 40)]:
        words = [w for w in re.split("|".join(map(re.escape, [chr(b) for b in range(256) if toxicity.SEPARATORS[b]])), t.strip()) if w]
        logits = [float(model.word_logits(pa.array([w]))[0][0]) for w in words]
        if not logits:
            continue
        beyond = sum(1 / (1 + math.exp(-toxicity.SHARP * max(-7, min(7, x - model.edge)))) for x in logits) / len(logits)
        odds = sum(math.exp(toxicity.SHARP * x) for x in logits) / len(logits)
        z = model.slopes[0] * math.log(beyond + toxicity.LITTLE) + model.slopes[1] * math.log(odds + math.exp(toxicity.SHARP * (model.edge - 7))) + model.shift
        assert math.isclose(float(model.score(pa.array([t]))[0]), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-3, abs_tol=1e-6)


def test_compressed_differences_are_those_of_plain_compressors(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = compressor.train(docs, labels)
    for t in ["a", "short text", "x" * 511, "y" * 512, "z" * 513, *texts()[110:130], texts()[206][:20_000]]:
        raw, diffs = t.encode(), []
        for at in range(0, len(raw), compressor.BLOCK):
            sizes = []
            for d in (model.good, model.bad):
                c = zstandard.ZstdCompressor(level=compressor.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes.append(len(c.compress(raw[at : at + compressor.BLOCK])))
            diffs.append(sizes[0] - sizes[1])
        x = [sum(diffs) / len(raw), max(diffs) / compressor.BLOCK, min(diffs) / compressor.BLOCK]
        mean, scale, w = model.calibration
        z = w[0] + sum(a * (b - m) / s for a, b, m, s in zip(w[1:], x, mean, scale, strict=True))
        assert math.isclose(float(model.score([t])[0]), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-2, abs_tol=2e-2)


def test_language_is_the_mean_over_words_of_whole_lines():
    rng = random.Random(84)
    train = [(prose(rng, 50, "abcdeé"), "aa") for _ in range(40)] + [(prose(rng, 50, "uvwxyzß"), "bb") for _ in range(40)]
    model = langid.fit([t for t, _ in train], [k for _, k in train])
    long = prose(rng, 700, "abcdeé") + " " + prose(rng, 500, "uvwxyzß") + "\n" + prose(rng, 3, "uvwxyzß")
    for t in (long, "abc", "uv xy\n\nab"):
        total, n = np.zeros(2), 0
        for line in t.split("\n"):
            words = [w for w in re.split(r"[^a-zA-Z\x80-\U0010ffff]+", line) if w]
            if not words:
                continue
            em = np.array([model.emissions(*langid.sw.stream(pa.array([w]), langid.SEPARATORS)[:3])[0] for w in words], float)
            a, b = np.zeros_like(em), np.zeros_like(em)
            a[0] = np.exp(model.start + em[0])
            a[0] /= a[0].sum()
            for i in range(1, len(words)):
                a[i] = np.exp(em[i]) * (a[i - 1] @ np.exp(model.transition))
                a[i] /= a[i].sum()
            b[-1] = 1
            for i in range(len(words) - 2, -1, -1):
                b[i] = np.exp(model.transition) @ (np.exp(em[i + 1]) * b[i + 1])
                b[i] /= b[i].sum()
            m = a * b
            total += (m / m.sum(1, keepdims=True)).sum(0)
            n += len(words)
        label, score = model.label(pa.array([t]))
        assert label == [model.labels[int(total.argmax())]] and math.isclose(score[0], total.max() / n, rel_tol=1e-4)


def test_decision_list_is_applied_in_order(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules.train(docs, labels)
    assert rules
    counts = quality_rules.statistics(docs).collect()
    want = []
    for r in counts:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        ratio = {k: r[a] / max(1, r[b]) for k, (a, b) in quality_rules.RATIOS.items()}
        hit = any(all((ratio[c.stat] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
        want.append((r.doc_id, r.n_words, base, not base and not hit))
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(docs, rules).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spans_are_added_as_the_weights_say(spark):
    rng = random.Random(85)
    rows = [(i, " ".join(rng.choice(["Phone: (547) 555-0128", "order 123-456-7890", "x 123 456 7890y", "+1 547 555 0128", "a@b.co", "4111 1111 1111 1111", "me (at) x.org", "q [at] y.zz", "1:2:3:4:5:6:7:8", "w"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(docs)
    model = pii.train(found)
    each = found.select("doc_id", F.explode("__wide").alias("s"))
    each = each.select("doc_id", "s.start", "s.end", "s.kind", *(v.alias(f"v{k}") for k, v in enumerate(pii.votes(F.col("s")))), *(f.alias(f"f{k}") for k, f in enumerate(pii.span_features(F.col("s")))))
    want = defaultdict(set)
    for r in each.collect():
        z = model.bias + sum((p if r[f"v{k}"] == 1 else m if r[f"v{k}"] == -1 else 0) for k, (p, m) in enumerate(model.weights)) + sum(w * r[f"f{k}"] for k, w in enumerate(model.features))
        if z > 0:
            want[r.doc_id].add(f"{pii.KINDS[r.kind]}:{r.start}:{r.end}")
    some = 0
    for r in pii.report(docs).collect():
        n = r.n_email + r.n_ip + r.n_card + r.n_phone
        spans = set(filter(None, r.spans.split(",")))
        assert want[r.doc_id] <= spans and len(spans) == n + len(want[r.doc_id])
        some += len(want[r.doc_id])
    assert some


def test_a_text_full_of_numbers_takes_its_time(spark):
    text = "547 555 0128 " * 5_000 + "4111.1111.1111.1111 " * 2_000
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 0 and len(row.base_sha256) == 64
