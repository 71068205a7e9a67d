"""Operators against plain versions on small fixtures, with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from typeloom.llm import bytewords, compressor, langid, mixing, ngramjoin, packing, pii, quality_rules, topk, toxicity, urlfilter
from typeloom.llm.common import bounded_sample, in_order, labelled_sample
from typeloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or [None] * len(texts))[i], None if t is None else len(t), -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "Two words", "ünï cödé — “x”\n\n", "a\x85b c\u00a0d", "x" * 3000]


# -- URL filter


def test_urls(spark):
    urls = {
        "http://a.example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "https://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://x.org/fr": ("x.org", "/fr", None, "allow"),
        "http://www.example.com/de/q": ("www.example.com", "/de/q", "example.com/de/", "block"),
        "http://net?x": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b.net/://c": ("b.net", "/://c", "net/", "block"),
        "http://a.b/x/Login/y": ("a.b", "/x/Login/y", None, "block"),
        "http://a.b/loginx/y.png/z": ("a.b", "/loginx/y.png/z", None, "allow"),
        "http://a.b/y.PNG?q": ("a.b", "/y.PNG", None, "block"),
        "http://a.b/l/page/12/": ("a.b", "/l/page/12/", None, "block"),
        "http://x.org/fr/login/": ("x.org", "/fr/login/", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, URL_RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    many = URL_RULES + [urlfilter.pattern_rule(f"p{i}", "block", f"/never{i}/", f"/never{i}/") for i in range(urlfilter.LITERAL_RULES)]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, many).collect()} == got
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = urlfilter.index_rules(URL_RULES)
    assert sorted(r.name for rs in index.values() for r in rs) == sorted(r.name for r in URL_RULES)
    assert "example" not in index


# -- mixing


def test_targets_stop_and_share_again():
    t = mixing.targets([("a", 100), ("b", 1000), (None, 10)])
    assert t["a"] == 200 and t[None] == 20 and math.isclose(sum(t.values()), 1.5 * 1110)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def test_mix(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) for _ in range(300))]
    sources = [rng.choice(["s1", "s1", "s1", "s2", "s3", None]) for _ in texts]
    docs = docs_of(spark, texts, sources=sources)
    docs = docs.union(docs.limit(3))
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect())) and len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == (len(WORD.findall(texts[r.doc_id])) if texts[r.doc_id] else 0)
        assert 0 <= r.taken <= 2 * r["size"]
        by[sources[r.doc_id]].append(r)
    want = mixing.targets([(s, sum(r["size"] for r in rs)) for s, rs in by.items()])
    for s, rs in by.items():
        assert math.isclose(rs[0].target, want[s]) and abs(sum(r.taken for r in rs) - want[s]) <= 1
        least = math.floor(want[s] / rs[0].source_size)
        assert all(r.taken >= least * r["size"] for r in rs)  # complete epochs come first
    assert mixing.mix(docs.limit(0)).count() == 0


# -- packing


def test_pack(spark):
    rng = random.Random(2)
    texts = [*ODD, "don't we'll İst <|endoftext|> 12 ½", *(prose(rng, rng.randint(1, 900), "abcdefghijklmnopqrstuvwxyzé.,!'") for _ in range(60)), prose(rng, 9000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = docs_of(spark, texts)
    rows = packing.pack(docs, path).collect()
    tok = Tokenizer.from_file(path)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r["length"], r.ids_crc32) for r in of[i]) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, 4097, 300)}
    plan = packing.plan_sequences(counts)
    used = Counter()
    for length, n in counts.items():
        number = np.arange(n)
        k = np.searchsorted(plan.key, (length << 44) + number, "right") - 1
        q = number - plan.first[k]
        for s, o in zip(plan.sequence[k] + q // plan.each[k], plan.offset[k] + q % plan.each[k] * length, strict=True):
            used.update((int(s), x) for x in (int(o), int(o) + length - 1))
            assert o + length <= 4096
    assert max(used.values()) <= 2 and plan.sequences <= sum(t for _, t in packing.best_fit(np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)]), 4096))


def test_program_covers_all_pieces():
    rng = np.random.default_rng(14)
    for low, high in ((1400, 1700), (1, 4097)):
        lengths = np.unique(rng.integers(low, high, 400))
        demand = rng.integers(1, 4, len(lengths))
        *between, (program, rest) = packing.solve_configurations(lengths, demand, 4096)
        assert between and rest == []
        for used in (program, *(a[: k * packing.ROUNDS] + b for k, (a, b) in enumerate(between, 1))):
            covered = np.zeros_like(demand)
            for (held, each), times in used:
                covered[held] += times * each
                assert (lengths[held] * each).sum() <= 4096 and times > 0
            assert (covered == demand).all()


# -- n-gram join


def brute_components(texts, n, p):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    f = ngramjoin.Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and sets[j] and 100 * c >= p * (len(a) + len(sets[j]) - c):
                f.join(i, j)
    return [(len(s), f.root(i)) for i, s in enumerate(sets)]


def edited(rng, base, share):
    copy = list(base)
    for _ in range(rng.randint(0, max(1, int(len(base) * share)))):
        copy[rng.randrange(len(copy))] = rng.choice(["edit", "other", "third"]) + str(rng.randrange(9))
    return " ".join(copy)


def joined(spark, texts, n, p):
    docs = docs_of(spark, texts).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs, n, p, 100).collect()}


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80)])
def test_join(spark, n, p):
    rng = random.Random(4)
    texts = [*ODD, *ODD, "Two Words", "two  words"]
    passage = prose(rng, 70)
    for _ in range(25):
        base = prose(rng, rng.choice([4, 9, 14, 25, 60, 200, 700])).split()
        texts += [edited(rng, base, 0.025) for _ in range(rng.randint(1, 7))]
        texts.append(f"{passage} {prose(rng, rng.choice([3, 12, 20, 90]))}")
    assert joined(spark, texts, n, p) == dict(enumerate(brute_components(texts, n, p)))


def test_join_of_clusters_beyond_a_tile_and_of_common_shingles(spark, monkeypatch):
    for name, value in (("TILE_DOCS", 8), ("PIVOTS", 2), ("COMMON", 0.02), ("LEAST", 3), ("BUCKET", 700), ("TASK_BUCKETS", 1)):
        monkeypatch.setattr(ngramjoin, name, value)
    rng = random.Random(41)
    texts = []
    for size, many in ((60, 70), (90, 40), (12, 30), (400, 25)):
        base = prose(rng, size).split()
        # Chains: each copy is made of the one before, so the ends don't link with each other.
        for _ in range(many):
            base = edited(rng, base, 0.02).split()
            texts.append(" ".join(base))
    texts += [prose(rng, 50) for _ in range(30)]
    rng.shuffle(texts)
    for n, p in ((3, 90), (5, 80)):
        want = brute_components(texts, n, p)
        assert joined(spark, texts, n, p) == dict(enumerate(want))
        assert max(Counter(c for _, c in want).values()) > 8


def test_sets_that_link_share_a_prefix_shingle_and_touching_bands():
    rng = np.random.default_rng(42)
    for p, q in ((80, 100), (90, 100), (1, 2), (1, 1)):
        for _ in range(300):
            a = int(rng.integers(1, 400))
            both = int(rng.integers(1, a + 1))
            b = both + int(rng.integers(0, 60))
            if both * q < p * (a + b - both):
                continue
            k = ngramjoin.prefix_length(np.array([a, b]), p, q)
            # The worst case: all that either lacks comes first in the order.
            assert a - both < k[0] and b - both < k[1]
            band = ngramjoin.band_of(np.array([a, b]), p, q)
            assert abs(band[0] - band[1]) <= 1
            low, high = sorted((a, b))
            assert ngramjoin.band_of(np.array([high]), p, q)[0] <= ngramjoin.band_of(np.array([low * q // p]), p, q)[0]


def test_join_of_repeated_ids(spark):
    rng = random.Random(43)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (7, b + " end"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngramjoin.jaccard_components(docs, 5, 80, 100).where("n_shingles > 0").collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 5)]


def test_join_of_nothing_and_of_rows_without_id(spark):
    docs = docs_of(spark, ["a b c d e f g", "a b c d e f g"])
    assert ngramjoin.jaccard_components(docs.limit(0)).count() == 0
    rows = ngramjoin.jaccard_components(docs.withColumn("doc_id", F.when(F.col("doc_id") == 1, F.col("doc_id")))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("1", "1"), ("None", "None")]


@pytest.mark.parametrize("across", [False, True])
def test_tree_join_and_what_it_leaves_out(across):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(20, 300)).astype(np.uint64)
        for _ in range(8):
            keep = base[rng.random(len(base)) > 0.03]
            sets.append(np.unique(keep))
    tile = np.arange(len(sets)) % 2
    seen: dict = {}
    forest = ngramjoin.tree_join(sets, tile, 90, 100, across, seen)
    plain = ngramjoin.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if (not across or tile[i] != tile[j]) and 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                plain.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [plain.root(i) for i in range(len(sets))]
    assert seen["verified"] < len(sets) ** 2 / 20


# -- personal data

PERSONAL = [
    "mail a@b.co, c.d+e@x-y.z.org;f@g", "10.0.0.255 and 1.2.3.256 and 1.2.3.4.5 and 01.002.3.4", "4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111x",
    "call +1 (547) 555-0128, +33 1 23 45 67 89 or +1 2", "a@b.com_x@y.org é😀 z@w.de", "7" * 5000, "a" * 5000 + "@", "+" + "(" * 3000, "1 " * 30,
    "Phone: (547) 555-0128 or 547.555.0199; user at mail (at) host.com; version 123-456-7890", None, "", "no data",
]


def plain_spans(t):
    out = []
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) < 256 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and luhn or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    docs = docs_of(spark, PERSONAL)
    for r in pii.report(docs).collect():
        want = plain_spans(PERSONAL[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    more = {r.doc_id: r.spans for r in pii.report(docs).collect()}[9]
    assert "phone:7:21" in more and "email:" in more
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "mail <EMAIL>, <EMAIL>;f@g" and clean[4] == "<EMAIL>_x@y.org é😀 <EMAIL>".replace("_x@y.org", "<EMAIL>") and clean[10] is None and clean[12] == "no data"
    assert pii.report(docs.limit(0)).count() == 0


def test_votes_tell_labelers_apart():
    none = (0,) * len(pii.SPAN_FEATURES)
    votes = [((1, 1, 1, 0, 1), none, 50), ((1, 1, 0, 0, 1), none, 200), ((0, -1, 0, -1, -1), none, 80), ((0, 1, 0, 0, 1), none, 5)]
    model = pii.aggregate_votes(votes)
    assert all(0 < x < 1 for pair in model.reliability.values() for x in pair)
    assert model.weights[0][0] > 0 and model.weights[3][1] < 0 and pii.aggregate_votes([]).bias == 0


def test_estimates_meet_the_truth_that_votes_come_from():
    """Against a plain form of the same steps over single candidates, and against the truth they were drawn from."""
    rng = random.Random(31)
    true_rate = [{1: (0.8, 0.15, 0.05), 0: (0.05, 0.15, 0.8)}, {1: (0.6, 0.3, 0.1), 0: (0.2, 0.3, 0.5)}, {1: (0.3, 0.6, 0.1), 0: (0.1, 0.6, 0.3)}, {1: (0.1, 0.8, 0.1), 0: (0.0, 0.5, 0.5)}, {1: (0.7, 0.2, 0.1), 0: (0.4, 0.2, 0.4)}]
    drawn = []
    for _ in range(3000):
        z = int(rng.random() < 0.3)
        drawn.append((z, tuple(rng.choices((1, 0, -1), r[z])[0] for r in true_rate)))
    counts = Counter(v for _, v in drawn)
    soft, rate = pii.estimate(counts)
    assert sum((soft[v] > 0.5) == (z == 1) for z, v in drawn) > 2800
    assert all(abs(rate[k][z][x] - true_rate[k][z][i]) < 0.06 for k in range(5) for z in (0, 1) for i, x in enumerate((1, 0, -1)))
    share, plain = 0.5, [{z: dict(pii.GIVEN[z]) for z in (0, 1)} for _ in range(5)]
    for _ in range(50):
        chance = []
        for _, v in drawn:
            a, b = share, 1 - share
            for k, x in enumerate(v):
                a, b = a * plain[k][1][x], b * plain[k][0][x]
            chance.append(a / (a + b))
        share = (sum(chance) + 0.5 * pii.PRIOR) / (len(drawn) + pii.PRIOR)
        for k in range(5):
            for z in (0, 1):
                w = {x: pii.PRIOR * pii.GIVEN[z][x] + sum(c if z else 1 - c for c, (_, v) in zip(chance, drawn, strict=True) if v[k] == x) for x in (1, 0, -1)}
                plain[k][z] = {x: y / sum(w.values()) for x, y in w.items()}
    assert all(math.isclose(rate[k][z][x], plain[k][z][x], rel_tol=1e-6) for k in range(5) for z in (0, 1) for x in (1, 0, -1))


def test_wide_spans_give_way_as_a_plain_look_at_all_pairs_says(spark):
    rng = random.Random(32)
    texts = [" ".join(rng.choice(["547 555 0128", "(547) 555-0128", "4111.1111.1111.1111", "4111 1111 1111 1111", "+1 547 555 0128", "a@b.co", "me (at) x.org", "12", "x"]) for _ in range(rng.randint(0, 400))) for _ in range(12)]
    for r in pii.candidates(docs_of(spark, texts)).collect():
        t = texts[r.doc_id]
        wide = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) if (kind, False) in pii.NEEDS and pii.NEEDS[kind, False] in t or kind in ("card", "phone") for m in re.finditer(pii.WIDE[kind].replace("}+", "}"), t)]
        base = plain_spans(t)
        touch = lambda a, b: a[0] < b[2] and b[0] < a[2]
        want = [a for a in wide if not any(touch(a, b) for b in base) and not any(touch(a, b) and b[:2] < a[:2] for b in wide)]
        assert sorted((s.start, s.kind, s.end) for s in r["__wide"]) == sorted(want)
        assert sorted((s.start, s.kind, s.end) for s in r["__base"]) == base


def test_redaction_of_tables_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.co", "x", "y", 3)], "doc_id long, text string, base string, spans string, wide int")
    assert pii.redact(df).collect()[0][:] == (1, "to <EMAIL>", "x", "y", 3)


# -- top-k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = (rng.normal(0, 1, (700, 12)) * rng.choice([0.1, 1, 5], (700, 1))).tolist()
    for i in range(0, 700, 50):
        v[i] = (np.array(v[i + 1]) * 1.01).tolist()
    v[3], v[4], v[5], v[6] = None, [1.0] * 11 + [None], [float("nan")] * 12, [math.inf] + [0.0] * 11
    v[7] = [1.0, 2.0]
    rows = [(i, x, 0, i) for i, x in enumerate(v)] + [(8, v[8], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 25 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = {i: np.floor(1024 * np.array(x, float)) for i, x in enumerate(v) if i not in (3, 4, 5, 6)}
    for q in range(0, 700, 25):
        best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 25 == 0).count() == 0


def best_of(v, q, k=10):
    ok = {i: x for i, x in v.items() if len(x) == len(v[q])}
    return sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in ok.items() if i != q)[:k]


def test_top_k_of_huge_components_and_ties(spark):
    rng = random.Random(61)
    v = {i: [rng.choice([-1e5, 1e5, 12345.5, 3.25]) * rng.choice([1, 1 + 2**-30]) for _ in range(8)] for i in range(300)}
    v |= {i: [float(i % 3), 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0] for i in range(300, 700)}
    v |= {700: [1e300] + [0.0] * 7, 701: [-1e18] * 8, 702: [0.0] * 8, 800: [0.0] * 8}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    sent = {}
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, sent=sent).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    ints = {i: [math.floor(1024 * x) for x in w] for i, w in v.items() if i not in (700, 701)}
    assert sorted(got) == [0, 100, 200, 300, 400, 500, 600, 800]
    for q in got:
        assert got[q] == best_of(ints, q)


def test_blocks_that_are_too_short_are_not_sent(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERIES", 8), ("GROUP", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(62)
    v = rng.normal(0, 1, (1200, 6)) * (2.0 ** -(np.arange(1200) // 60))[:, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    sent = {}
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, sent=sent).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    ints = {i: [math.floor(1024 * x) for x in w] for i, w in enumerate(v.tolist())}
    assert all(got[q] == best_of(ints, q) for q in range(0, 1200, 10))
    assert sent["blocks"] < 0.7 * sent["all"]


def test_buckets_are_pruned_both_ways():
    rng = np.random.default_rng(7)
    q = rng.normal(0, 100, (5, 8)).round()
    near = np.concatenate([q + rng.normal(0, 5, q.shape).round() for _ in range(4)])
    far = rng.normal(0, 100, (500, 8))
    far = (far / np.linalg.norm(far, axis=1, keepdims=True) * 250).round()
    s = topk.Searcher(np.arange(5), q, np.full(5, topk.NO_BOUND), 3)
    s.bucket(np.arange(100, 120), near)
    s.bucket(np.arange(1000, 1500), far)
    s.bucket(np.arange(2000, 2500), far / 100)
    assert s.tally["by coordinate"] and s.tally["left out"] and s.tally["verified"] < 5 * 1020
    c = np.concatenate([near, far, far / 100])
    ids = np.concatenate([np.arange(100, 120), np.arange(1000, 1500), np.arange(2000, 2500)])
    for i in range(5):
        want = ids[np.lexsort((ids, -(c @ q[i])))][:3]
        assert s.c[s.q == i].tolist() == want.tolist()


@pytest.mark.parametrize("short", [(5, 9), (0, 0)])
def test_top_k_of_a_query_that_points_against_a_tight_cluster(spark, short):
    v = [(100, 0), (100, 1), (-100, 0), *((100, y) for y in range(-10, 10)), *[short] * 20]
    df = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") < 3, scale=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(3):
        best = sorted((-(v[q][0] * x + v[q][1] * y), i) for i, (x, y) in enumerate(v) if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in best]


# -- quality rules


def test_statistics():
    rng = random.Random(8)
    texts = [*(t or "" for t in ODD), "a b c a b c a\nx y\nx y\n\n \n x y", "###! A!! %%", *(prose(rng, 80, "ab") + "\n" + prose(rng, 3, "a") for _ in range(40))]
    got = quality_rules.count_statistics(*bytewords.texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(win)
        covered = {k + d for k, x in enumerate(win) if often[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS[:5]) == want


def test_learned_list(spark):
    rng = random.Random(9)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 80).split()) for _ in range(30)] + [prose(rng, 80).upper() for _ in range(30)]
    docs = docs_of(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rules = quality_rules.train(docs, labels)
    assert 1 <= len(rules) <= 4
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(docs, rules).collect()}
    assert all(kept[i][1] or kept[i][0] for i in range(60)) and not any(kept[i][1] for i in range(60, 122))
    assert quality_rules.train(docs, labels.limit(0)) == [] and quality_rules.judge(docs.limit(0), rules).count() == 0


# -- samples


def test_samples_are_bounded_by_row_and_lose_no_class(spark):
    one_id = [(7, f"text {i}", "a") for i in range(3000)]
    same = [(8, "same", "b")] * 3000
    few = [(i, f"few {i}", "c") for i in range(5)]
    docs = spark.createDataFrame([*one_id, *same, *few, (9, "x", None)], "doc_id long, text string, kind string")
    take = lambda df: sorted(map(tuple, bounded_sample(df, 100, "kind", "doc_id", F.xxhash64("text")).collect()))
    got = take(docs)
    n = Counter(k for *_, k in got)
    assert 50 <= n["a"] <= 180 and 1 <= n["b"] <= 180 and n["c"] == 5 and set(n) == {"a", "b", "c"}
    assert take(docs.repartition(5)) == got and take(docs.limit(0)) == []


def test_labelled_samples_take_repeated_ids_and_labels(spark):
    docs = spark.createDataFrame([(0, f"t{i}") for i in range(400)] + [(2, "u"), (3, "v"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)] * 50 + [(2, 0), (2, 1), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    sample, share = labelled_sample(docs, labels, "quality", 20)
    keep = {i for i in (0, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    known = [(i, y) for i, y in ((0, 1), (2, 0), (2, 1), (3, 0)) if i in keep]
    got = [(r.doc_id, r.y) for r in in_order(sample, "text", "y")]
    assert math.isclose(share, sum(y for _, y in known) / len(known)) and set(got) == set(known) and len(got) <= 2 * 84


# -- learned scores


def labelled(spark, good, bad, column):
    texts = [*good, *bad, *ODD]
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) + len(bad))], f"doc_id long, {column} int")
    return docs_of(spark, texts), labels, len(good), len(bad)


def test_compression_classifier(spark):
    rng = random.Random(10)
    good, bad = [prose(rng, 120, "aeiourst") for _ in range(90)], [prose(rng, 120, "xqzjkw#%") for _ in range(90)]
    docs, labels, n, m = labelled(spark, good, bad, "quality")
    model = compressor.train(docs, labels)
    got = {r.doc_id: r for r in compressor.score_documents(docs, model, ("doc_id",)).collect()}
    assert sum(got[i].predicted == 1 for i in range(n)) >= 88 and sum(got[n + i].predicted == 0 for i in range(m)) >= 88
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == n + m + len(ODD)
    none = compressor.score_documents(docs, compressor.train(docs, labels.limit(0)), ("doc_id",))
    assert none.count() == len(got) and compressor.score_documents(docs.limit(0), model, ("doc_id",)).count() == 0


def test_toxicity_of_words_and_their_misspellings(spark):
    rng = random.Random(11)
    plain = lambda n: prose(rng, n, "aeiourstln")
    toxic = [f"{plain(60)} {rng.choice(['zorgblat', 'krimpwick', 'vuxmonger'])} {plain(60)}" for _ in range(120)]
    docs, labels, n, m = labelled(spark, toxic, [plain(120) for _ in range(150)], "toxic")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert sum(got[i].predicted == 1 for i in range(n)) >= 115 and sum(got[n + i].predicted == 0 for i in range(m)) >= 148
    one = lambda t: float(model.score(pa.array([t]))[0])
    assert one("so zorgblatt is") > one("so lorantsei is") and 0 <= one(None) <= 1 and one("") == one(None)
    assert toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).count() == len(got)


def test_languages(spark):
    rng = random.Random(12)
    a, b = (lambda n: prose(rng, n, "abcdeé")), (lambda n: prose(rng, n, "uvwxyzß"))
    texts = [*(a(60) for _ in range(80)), *(b(60) for _ in range(80)), a(50) + "\n" + b(10), *ODD, "12 -- 3", "日本"]
    langs = ["aa"] * 80 + ["bb"] * 80 + ["aa"] + [None] * (len(ODD) + 2)
    docs = docs_of(spark, texts, langs)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.label_documents(docs, model).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in range(161)) >= 160
    assert [got[161 + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[169].lang_pred == "und" and got[170].lang_pred in ("aa", "bb")
    stream, s, e, row, data = langid.sw.stream_and_bytes(pa.array([texts[160]]), langid.SEPARATORS)
    marginal, _, _ = langid.forward_backward(model.emissions(stream, s, e).astype(float), langid.chains_of(data, s, e, row), model.transition, model.start)
    assert (marginal[:50].argmax(1) == 0).mean() > 0.9 and (marginal[50:].argmax(1) == 1).mean() > 0.8
    assert {r.lang_pred for r in langid.label_documents(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_plain_chains_come_from_all_languages():
    of_line, rng = np.repeat(np.arange(4), 500), np.random.default_rng(15)
    lines = langid.chain_lines(of_line, np.full(2000, 10), 10_000, rng)
    plain = of_line[lines[len(lines) // 2 :]]
    assert 990 <= len(lines) <= 1010 and len(set(lines.tolist())) == len(lines)
    assert np.bincount(plain, minlength=4).min() >= 80 and (plain[1:] == plain[:-1]).mean() > 0.7


def test_messages_cross_long_lines():
    rng = np.random.default_rng(16)
    begin = np.array([0, 1, 400, 407, 1200])
    em, tr, st = rng.normal(0, 3, (1300, 4)), rng.normal(0, 2, (4, 4)), rng.normal(size=4)
    want, _, _ = langid.forward_backward(em, begin, tr, st)
    for block in (1, 2, 7, 128, 5000):
        assert np.allclose(langid.marginals(em, begin, tr, st, block), want)
    # One word that no transition fits decides a line from far.
    em = np.zeros((600, 2))
    em[0, 1] = 9.0
    assert (langid.marginals(em, np.array([0]), np.array([[20.0, 0.0], [0.0, 20.0]]), np.zeros(2))[:, 1] > 0.99).all()


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(13)
    em, tr, st, begin = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([0, 3, 4])
    got, _, z = langid.forward_backward(em, begin, tr, st)
    want, total = np.zeros_like(em), 0.0
    for a, b in zip(begin, [*begin[1:], 7], strict=True):
        paths = [()]
        for _ in range(b - a):
            paths = [(*p, k) for p in paths for k in range(3)]
        w = np.array([math.exp(st[p[0]] + sum(em[a + i, k] for i, k in enumerate(p)) + sum(tr[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        total += math.log(w.sum())
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, k in enumerate(p):
                want[a + i, k] += x
    assert np.allclose(got, want) and math.isclose(z, total)
