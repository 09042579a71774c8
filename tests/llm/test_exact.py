"""Operators with an exact answer against brute force, and registered SQL against DuckDB."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import components, decontaminate, near_copies, packing, queries, rules, sentences, simhash, suffix_dedup, token_files, tokens, windows

from .data import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, radius):
    """Component number of each distinct value."""
    found = {v: v for v in values}
    for _ in values:
        new = {v: min(found[u] for u in values if (u ^ v).bit_count() <= radius) for v in values}
        if new == found:
            return found
        found = new
    return found


def test_simhash(spark):
    rows = documents()
    prints = [fingerprint(r[1]) for r in rows]
    of = grouped(sorted(set(prints)), 2)
    least = {}
    for r, f in zip(rows, prints):
        if r[0] is not None:
            least[of[f]] = min(least.get(of[f], r[0]), r[0])
    want = [(r[0], f"{f:016x}", least.get(of[f])) for r, f in zip(rows, prints)]
    got = [tuple(x) for x in simhash.near_duplicates(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.one_of_each(frame(spark)).collect()
    assert len(kept) == len(set(of.values())) and sorted(r["doc_id"] for r in kept) == sorted(least.values())
    assert simhash.near_duplicates(frame(spark, empty=True)).count() == 0


def similar(rows):
    """Ids that stay of each group of texts whose 5-word Jaccard links are 0.8 or more."""
    split = [WORD.findall(lower(r[1] or "")) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(least.values()), len(set(group))


def test_near_copies(spark):
    """The pipeline's stage against brute force: copies just at, above and under 0.8, a chain, a large group."""
    import random

    import corpus_pipeline

    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, base, chain, many = documents(), words(49), words(400), words(300)
    for k in (4, 5, 6):  # 45 shingles, of which k at the end change: 0.84, 0.8, 0.76
        rows.append((100 + k, " ".join(base[: 49 - k] + words(k)), "en", "a"))
    rows.append((100, " ".join(base), "en", "a"))
    for k in range(8):
        rows.append((110 + k, " ".join(chain[20 * k : 20 * k + 240]), "en", "a"))
    for k in range(60):
        own = list(many)
        for _ in range(r.choice((0, 1, 4, 7))):
            own[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows.append((200 + k, " ".join(own), "en", "a"))
    want, groups = similar(rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), "").collect()
    assert sorted(x["doc_id"] for x in kept) == want and len(kept) == groups
    assert 104 not in want and 105 not in want and 106 in want
    assert corpus_pipeline.near_duplicate_stage(spark, frame(spark, empty=True), "").count() == 0


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 6])
def test_near_copies_by_fingerprint(spark, bucket):
    """All pairs within the radius, but for fingerprints with many neighbours, against brute force."""
    import random

    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, many = documents(), words(300)
    for k in range(12):
        base = words(80 + 10 * k)
        for j in range(3):
            rows.append((100 + 3 * k + j, " ".join(base[: len(base) - j * k] + words(j * k)), "en", "a"))
    for k in range(30):
        own = list(many)
        for _ in range(r.choice((0, 1, 4, 7))):
            own[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows.append((200 + k, " ".join(own), "en", "a"))
    prints = near_copies._sketches(frame(spark, rows), "text", "doc_id").where("n > 0").select("sid", "n", "fp").distinct()
    want = {}
    for _, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        found = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), seed=42) for i in range(max(1, len(w) - 4))} if w else set()
        if found:
            want[xxhash.xxh64_intdigest(np.array(sorted(found), "<u8").tobytes())] = len(found), sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))
    assert {simhash.signed(k): (n, simhash.signed(f)) for k, (n, f) in want.items()} == {x["sid"]: (x["n"], x["fp"]) for x in prints.collect()}
    least = {}
    for k, (n, f) in want.items():
        least[f] = min(least.get(f, (1 << 63, 0)), (simhash.signed(k), n))
    near = {f: [g for g in least if g != f and (f ^ g).bit_count() <= near_copies.RADIUS] for f in least}
    fits = lambda a, b: 10 * min(a, b) >= 8 * max(a, b)
    pair = lambda f, g: (max(least[f][0], least[g][0]), min(least[f][0], least[g][0]))
    equal = {(simhash.signed(k), least[f][0]) for k, (n, f) in want.items() if simhash.signed(k) != least[f][0] and fits(n, least[f][1])}
    could = {pair(f, g) for f in near for g in near[f] if fits(least[f][1], least[g][1])}
    must = {pair(f, g) for f in near for g in near[f] if fits(least[f][1], least[g][1]) and len(near[f]) <= simhash.FEW}
    got = {tuple(x) for x in near_copies.by_fingerprint(prints, bucket=bucket).collect()}
    assert equal | must <= got <= equal | could and len(must) > 20 and len(got) < len(could)
    assert all(any(pair(f, g) in got for g in near[f]) for f in near if len(near[f]) > simhash.FEW)


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    """The pipeline's stage has its first links from the operator of op1, checked by whole sets."""
    import corpus_pipeline

    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius, *rest: asked.append((fps.count(), radius)) or links(fps, radius, *rest))
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark), "").collect()
    assert len(asked) == 1 and asked[0][0] > 30 and asked[0][1] == near_copies.RADIUS >= 10
    assert sorted(x["doc_id"] for x in kept) == similar(documents())[0]


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_are_complete(spark, bucket):
    import random

    r = random.Random(5)
    values = set()
    for _ in range(12):
        v = r.getrandbits(64)
        for _ in range(r.choice((1, 6, 40))):
            for _ in range(r.choice((1, 2, 3))):
                v ^= 1 << r.randrange(64 if r.random() < 0.5 else 9)
            values.add(v)
    of = grouped(sorted(values), 2)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df, 2, bucket)).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        mine[of[v]].add(v)
        theirs[found.get(simhash.signed(v), simhash.signed(v))].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds():
    t, cost = simhash.allocate([[0, 10, 50, 90], [0, 1, 2, 3], [0, 5, 9, 20]], 2)
    assert sum(x + 1 for x in t) == 3 and cost == 3 and t == [-1, 2, -1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def repeats(rows, size):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    for d, b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        yield d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()


@pytest.mark.parametrize("size,gram,hot", [(200, 32, 20_000), (64, 32, 20_000), (64, 16, 1)])
def test_repeated_strings(spark, size, gram, hot):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark), size=size, gram=gram, hot=hot))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(repeats(documents(), size), key=str)


def test_repeated_rows_cost_no_square(spark):
    """Many repeats of one row: all copies go from op4, the first place stays in op6, and lists of spans stay short."""
    rows = [documents()[-5]] * 60 + documents()[:5]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark, rows), size=200))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(repeats(rows, 200), key=str)
    assert sorted(map(tuple, sentences.without_repeats(frame(spark, rows)).collect()), key=str) == sorted(spans(rows, 2), key=str)


def test_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(frame(spark, empty=True)).count() == 0
    text = suffix_dedup.remove_repeats(frame(spark), size=64, carry=["lang"]).select("carry.lang", suffix_dedup.text_of(F.col("kept")).alias("t")).collect()
    assert len(text) == len(documents())


def test_long_text_windows():
    """Blocks of a long text meet without a gap."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    data[300_000:300_500] = data[1000:1500]
    gram, at, lo, hi = windows.anchors(data, 200, 32)
    assert lo[0] == 0 and hi[-1] == len(data) - 200 and (lo[1:] == hi[:-1] + 1).all()
    assert ((at >= lo) | (at <= hi + 168)).all()


def test_radix_passes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(0, 2900)
    for size in (8, 11, 20):
        count = Counter(data[s : s + size].tobytes() for s in starts)
        want = [count[data[s : s + size].tobytes()] > 1 for s in starts]
        assert windows.repeated(data, starts, np.zeros(len(starts), np.int64), size).tolist() == want


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    mark = [0] * len(words)
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark)
    return *counts, len(words) < 20 or 100 * sum(mark) > 30 * len(words)


def verdict(rows):
    """The rules in numpy, group by group."""
    u, d = rules.UNIT, len(rules.NAMES)
    out = []
    for r in rows:
        t, b = r[1] or "", base(r[1])
        per = lambda n, b=b: np.log(1 + 100 * n / max(b[1], 1))
        x = [np.log(max(b[1], 1) / max(b[0], 1)), per(b[2]), per(sum(c in "!?" for c in t)), per(sum("A" <= c <= "Z" for c in t)), per(sum(c in ".,;:" for c in t))]
        out.append([r[0], *b, np.floor(np.array(x) * u + 0.5), r[2] or "\x00", r[3] or "\x00"])
    good = [o for o in out if not o[6]]
    pair, lang = Counter((o[8], o[9]) for o in good), Counter(o[8] for o in good)
    name = lambda o: (o[8], o[9]) if pair[o[8], o[9]] >= rules.LEAST_ROWS else (o[8],) if lang[o[8]] >= rules.LEAST_ROWS else ()
    bins = lambda d2: np.floor(np.log2(d2 + 1e-6) * rules._BINS)
    result = []
    for g in {name(o) for o in out}:
        x = np.array([o[7] for o in good if name(o) == g])
        if len(x):
            q = np.percentile(x, [25, 50, 75], axis=0)
            half = min(len(x), (len(x) + d + 1) // 2)

            def estimate(near):
                return near.mean(0), np.linalg.inv(np.linalg.cholesky(np.cov(near, rowvar=False, bias=True) + rules.FLOOR**2 * np.eye(d)))

            def step(m, inv):
                b = bins((((x - m) @ inv.T) ** 2).sum(1))  # noqa: B023
                return estimate(x[b <= np.sort(b)[half - 1]])  # noqa: B023

            size = lambda e: -2 * np.log(np.diag(e[1])).sum()
            starts = [(q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, rules.FLOOR))), (q[1], np.eye(d) / rules.FLOOR), estimate(x)]
            for _ in range(rules.SCREEN):
                starts = [step(*e) for e in starts]
            now = min(starts, key=size)
            for _ in range(rules.STEPS):
                new = step(*now)
                if size(new) > size(now) - 1e-12:
                    break
                now = new
            m, inv = now
            b = bins((((x - m) @ inv.T) ** 2).sum(1))
            scale = max(1.0, 2 ** ((np.sort(b)[int(np.ceil(0.5 * len(b))) - 1] + 1) / rules._BINS) / rules._CHI2_MEDIAN_5)
        for o in out:
            if name(o) == g:
                far = None if o[6] or not len(x) else (((o[7] - m) @ inv.T) ** 2).sum() / scale
                result.append((*o[:7], not o[6] and (far is None or far <= rules.CUTOFF), far))
    return result


def test_quality_rules(spark):
    rows = []
    for seed in range(12):
        rows += [(None if r[0] is None else r[0] + 1000 * seed, *r[1:]) for r in documents(seed)]
    rows += [(90_000 + k, ("WOW!! #*$ " * (20 + k)).replace("W", "WX" * (k + 1)), "en", "a") for k in range(5)]
    rows += [(95_000 + k, " ".join(f"#{chr(97 + (k + j) % 26)}!!$%" for j in range(60)), "en", "a") for k in range(5)]
    got = sorted((tuple(r) for r in rules.verdicts(frame(spark, rows)).collect()), key=str)
    want = sorted(verdict(rows), key=str)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert [g[8] is None for g in got] == [w[8] is None for w in want]
    assert np.allclose([g[8] for g in got if g[8] is not None], [w[8] for w in want if w[8] is not None], rtol=1e-6)
    strict = {r["doc_id"]: r["kept"] for r in rules.verdicts(frame(spark, rows), cutoff=20.0).collect()}
    assert not any(strict[95_000 + k] for k in range(5)) and sum(strict.values()) > 0.8 * sum(not g[6] for g in got)
    assert rules.verdicts(frame(spark, empty=True)).count() == 0


@pytest.mark.parametrize("share", [0.25, 0.4])
def test_estimate_survives_junk(spark, share):
    """Junk of up to two fifths of one source goes, and nothing else."""
    rng = np.random.default_rng(5)
    clean = rng.normal([330, 0, 20, 150, 180], [15, 8, 15, 40, 30], (600, 5))
    junk = rng.normal([340, 700, 500, 600, 200], [30, 40, 60, 40, 40], (int(600 * share / (1 - share)), 5))
    rows = [("g", *(int(v) for v in x)) for x in np.concatenate([clean, junk])]
    good = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{n} long" for n in rules.NAMES))
    far = good.join(rules.estimates(good), "grp").select("x1", (rules.distance() / F.greatest("scale", F.lit(1.0))).alias("far")).collect()
    assert {r["x1"] > 300 for r in far if r["far"] > rules.CUTOFF} == {True}
    assert sum(r["far"] > rules.CUTOFF for r in far) == len(junk)


def hits(rows, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower(t or ""))
    items = defaultdict(set)
    for i, t in bench:
        w = split(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            items[tuple(w[s : s + 13])].add(i)
    for r in rows:
        w, mark, found = split(r[1]), set(), set()
        for win, ids in items.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    mark |= set(range(s, s + len(win)))
                    found |= {str(i) for i in ids if i is not None}
        yield r[0], len(w), len(mark), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(mark) > 0 and 20 * len(mark) >= len(w)


@pytest.mark.parametrize("most", [200_000, 0])
def test_contamination(spark, most):
    rows = documents()
    words = rows[7][1].split()
    bench = [(1, " ".join(words[2:30])), (2, rows[8][1].upper()), (10, "umbra"), (11, "the of"), (3, None), (4, "..."), (None, " ".join(words[5:19])), (2, "quartz, velvet prose"), (5, "not anywhere in these texts at all, " * 4), (6, rows[-1][1][:40])]
    df = spark.createDataFrame(bench, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("win", F.lit("x"))
    got = decontaminate.digest(decontaminate.contamination(frame(spark), df, broadcast_windows=most))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(hits(rows, bench), key=str)
    nothing = decontaminate.digest(decontaminate.contamination(frame(spark), df.limit(0), broadcast_windows=most))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == len(rows)
    assert decontaminate.contamination(frame(spark, empty=True), df).count() == 0


def test_benchmark_stage(spark, tmp_path):
    """Any window of 13 words takes its document, however long that is; twelve words, or other order, don't."""
    import corpus_pipeline

    plain = lambda k, n: " ".join(f"{k}é{i}" for i in range(n))
    item = [f"Q{i}" for i in range(20)]
    rows = [
        (1, f"{plain('c', 5000)}. {' '.join(item).lower()}! {plain('d', 500)}", "en", "a"), (None, f"{plain('e', 900)}\n{' '.join(item[3:16])}", "en", "a"), (3, f"{plain('f', 100)} {' '.join(item)}", "en", "a"),
        (4, plain("g", 50), "en", None), (5, f"{plain('h', 400)} {' '.join(item[:12])}", "en", "a"), (6, None, "en", "a"), (7, " ".join(reversed(item)), "en", "a"), (None, plain("k", 9), None, None), (8, "", "en", "a"), (4, f"x {' '.join(item)}", "en", "a"), (5, f"{plain('h', 400)} {' '.join(item[:12])}", "en", "a"),
    ]
    spark.createDataFrame([(1, " ".join(item)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    out = corpus_pipeline.benchmark_stage(spark, docs, f"file://{tmp_path}")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(((r[0], r[1]) for r in rows if r not in (rows[0], rows[1], rows[2], rows[9])), key=str)


def test_native_operators_run_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (rules.verdicts(frame(spark)), decontaminate.contamination(frame(spark), bench)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def ids_of(text, end):
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_word_cache_equals_whole_texts():
    encode = tokens.encoder(tokens.default_vocabulary(), tokens.drops_space(tokens.default_vocabulary()))
    for text in [r[1] for r in documents()] + ["it's 've x y\x1cz", "<|endoftext|> a<|startoftext|>b", "é ́x ﬁ İI"]:
        assert (encode(text, 2) == ids_of(text, 2)).all()


def test_word_cache_on_random_strings():
    """Latin letters, marks, signs, spaces and special tokens in any order."""
    import random

    r = random.Random(11)
    parts = [*"aAzZéÉßİIıŒœ", "\u0301", "\u0307", "\u0323", *"'.,!?-_#<>|", *" \n\t\u00a0\u2003", "'s", "ADİ", "<|endoftext|>", "א", "\ufb1d", "\u0958", "漢", "9", "²", "😀"]
    encode, plain = tokens.encoder(tokens.default_vocabulary(), True), Tokenizer.from_file(tokens.default_vocabulary())
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(50_000)] + ["ADİ, BİLGİ."]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert encode(text, 2).tolist() == [*want.ids, 2], text


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for most in (0, 1, 9, 4000):
            v = np.concatenate(([0], np.cumsum(rng.integers(0, most + 1, n))))
            e = token_files.EliasFano.encode(v)
            assert (e.between(0, len(v)) == v).all() and all(e.select(int(k)) == v[k] for k in rng.integers(0, len(v), 30))
    assert e.n_bytes * 8 < len(v) * (np.log2(v[-1] / len(v)) + 3)


def test_token_files(spark):
    rows = documents()
    got = [tuple(r) for r in token_files.token_files(spark, frame(spark)).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = Counter((r[0], len(i := ids_of(r[1], 1)), zlib.crc32(i.tobytes())) for r in rows)
    assert Counter((g[0], g[2], g[3]) for g in got) == want
    assert [g[1] for g in got] == np.concatenate(([0], np.cumsum([g[2] for g in got])[:-1])).tolist()
    assert token_files.token_files(spark, frame(spark, empty=True)).count() == 0


def test_token_file_access(spark, tmp_path):
    manifest = token_files.write_files(frame(spark, documents()[:20]), f"file://{tmp_path}/t", tokens.default_vocabulary()).collect()
    by_id = {r[0]: r[1] for r in documents()[:20]}
    seen = 0
    for m in manifest:
        f = token_files.TokenFile(m["uri"])
        for k in range(f.n_docs):
            assert (f.document(k) == ids_of(by_id[int(f.doc_ids[k])], 1)).all()
            seen += 1
        f.close()
    assert seen == 20


def test_packing(spark):
    rows = documents()
    got = packing.pack(frame(spark)).toPandas()
    assert got["length"].min() > 0
    total = Counter()
    for seq, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate(([0], np.cumsum(g["length"])[:-1])).tolist() and g["length"].sum() <= 4096
        total[seq] = int(g["length"].sum())
    assert sorted(total) == list(range(len(total)))
    want = Counter((r[0], len(ids_of(r[1], 2))) for r in rows)
    assert Counter((i, t) for i, t, s in zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got.doc_tokens, got.start) if s == 0) == want
    # Every id of every document stands in exactly one piece.
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(ids_of(r[1], 2))
    for i, g in got.groupby(got.doc_id.astype(object).where(got.doc_id.notna(), -1)):
        every = texts[None if i == -1 else i]
        places = Counter((int(t), int(s), int(n)) for t, s, n in zip(g.doc_tokens, g.start, g["length"]))
        want = Counter()
        for t, own in Counter(len(x) for x in every).items():
            at = 0
            for n, _ in packing.cut(t):
                want[t, at, n] += own
                at += n
        assert places == want
        for s, n, c, t in zip(g.start, g["length"], g.ids_crc32, g.doc_tokens):
            assert c in {zlib.crc32(x[s : s + n].tobytes()) for x in every if len(x) == t}
    # Little padding: the last sequence aside, under a hundredth.
    assert 4096 * (len(total) - 1) < 1.01 * sum(total.values()) + 4096
    assert packing.pack(frame(spark, empty=True)).count() == 0


def test_cut():
    slots = {int(k): 4096 // int(k) for k in packing.classes()}
    for n in [*range(1, 5000), 40_000]:
        pieces = packing.cut(n)
        assert sum(p for p, _ in pieces) == n and all(0 < p <= slots[k] for p, k in pieces)
        assert sum(slots[k] - p for p, k in pieces) <= n * packing.WASTE + 1


def spans(rows, span):
    keyed = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).view(np.int64))))
    seen, gone = set(), defaultdict(set)
    for key in keyed:
        pieces = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", key[1])
        at = [k for k, p in enumerate(pieces) if re.sub(r"[.!? \t\n\r\x0b\x0c]", "", p)]
        for s in range(len(at) - span + 1):
            run = tuple(pieces[k].strip(" \t\n\r\x0b\x0c") for k in at[s : s + span])
            if run in seen:
                gone[key] |= set(at[s : s + span])
            seen.add(run)
    for r in rows:
        key = (r[0], r[1] or "")
        pieces = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", key[1])
        n = sum(1 for p in pieces if re.sub(r"[.!? \t\n\r\x0b\x0c]", "", p))
        yield r[0], n, len(gone[key]), "".join(p for k, p in enumerate(pieces) if k not in gone[key])


@pytest.mark.parametrize("span", [2, 3, 1])
def test_sentence_spans(spark, span):
    got = sentences.without_repeats(frame(spark), span=span).collect()
    assert sorted(map(tuple, got), key=str) == sorted(spans(documents(), span), key=str)
    assert sentences.without_repeats(frame(spark, empty=True)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
