"""Operators on defined edge cases against plain versions, and on empty tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.llm import ann, bpe, language, lines, lm, mixing, neardup, pii, quality, tokenfile

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(corpus):
    return [(r.doc_id, r.text or "") for r in corpus.collect()]


def test_line_dedup(corpus, empty):
    docs = docs_of(corpus)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, text in docs:
        if i is not None:
            for line in text.split("\n"):
                holders[key(line)].add(i)
    want = []
    for i, text in docs:
        own = text.split("\n")
        drop = lambda k: i is not None and len(k) >= 10 and len(holders[k]) > 1 and i > min(holders[k])  # noqa: B023, E731
        kept = [x for x in own if not drop(key(x))]
        want.append((i or -1, "\n".join(kept), len(own), len(own) - len(kept)))
    done = lines.dedup_lines(corpus)
    assert done.select("source_row.*").columns == corpus.columns
    got = [(r.doc_id or -1, r.kept_text, r.n_lines, r.n_dropped) for r in done.select("source_row.doc_id", "kept_text", "n_lines", "n_dropped").collect()]
    assert sorted(got) == sorted(want)
    # a filter far too small only sends more lines to be confirmed
    tiny = lines.dedup_lines(corpus, segment_bits=1, max_filter_bytes=16)
    assert sorted(r.kept_text for r in tiny.collect()) == sorted(w[1] for w in want)
    assert lines.dedup_lines(empty).count() == 0


def luhn_slowly(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn_slowly(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    found = [(m.start(), list(plain).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0])]
    return [f[2] for f in sorted(found)]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "a@b c@d.e x@y@z.com .@. a@b.c@d.e",
        "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.0255",
        "4111-1111 1111-1111 4111  1111 1111 1111 1234567812345670 5",
        "+1+12 345 678 90+1234567890 (x) +1 (017) 555-7713.",
        "9" * 5000 + " " + "1." * 4000 + "@" * 50,
    ],
)
def test_base_spans_equal_plain_patterns(text):
    found = pii.find_spans(text)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in pii.BASE_KINDS] == base_spans(text)


def test_pii_query_columns(corpus, empty):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(corpus)).collect() if r.doc_id}
    for i, text in docs_of(corpus):
        if i is not None:
            want = base_spans(text)
            assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert got[i].n_card == sum(w.startswith("card") for w in want)
    assert "iban" in got[14].spans and "ssn" in got[14].spans and "iban" not in got[13].spans
    text = next(t for i, t in docs_of(corpus) if i == 13)
    assert pii.redacted(text, pii.find_spans(text)).count("[") == 4
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_added_kinds_need_checksum_or_context():
    assert [s.kind for s in pii.find_spans("iban DE89370400440532013000")] == ["iban"]
    assert pii.find_spans("iban DE89370400440532013001") == []
    assert pii.find_spans("number 123-45-6789 here") == []
    assert [s.kind for s in pii.find_spans("my social security number is 123-45-6789")] == ["ssn"]


def quality_slowly(text):
    words = WORDS.findall(text)
    n = len(words)

    def inside(size, first_too):
        seen = collections.defaultdict(list)
        for k in range(n - size + 1):
            seen[tuple(words[k : k + size])].append(k)
        return {k + j for at in seen.values() if len(at) > 1 for k in (at if first_too else at[1:]) for j in range(size)}

    chars = sum(map(len, words))
    dup, dup_chars, earlier = 0, 0, set()
    for line in text.split("\n"):
        if line in earlier and WORDS.search(line):
            dup += 1
            dup_chars += sum(map(len, WORDS.findall(line)))
        earlier.add(line)
    grams = tuple(sum(len(words[k]) for k in inside(size, False)) for size in quality.WINDOW_LIMITS)
    repeat = len(inside(3, True))
    failed = n < 50 or 100 * repeat > 50 * n
    bad = 100 * dup_chars > quality.LINE_LIMIT * chars or any(100 * g > m * chars for g, m in zip(grams, quality.WINDOW_LIMITS.values(), strict=True))
    return quality.Quality(n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, dup_chars, grams, failed, not failed and not bad)


def test_quality_equals_plain_windows(corpus, empty):
    texts = [t for _, t in docs_of(corpus) if len(t) < 5000]
    texts += ["a b c " * 30, "one line here\n" * 20, "x#|y <b> " * 60, " ".join(f"w{k % 40}" for k in range(90)), "wörter été " * 3]
    texts.append(" ".join(f"u{k}" for k in range(80)) + "\n" + "\n".join(["seven words stand in this repeated line"] * 9))
    for text in texts:
        assert quality.measure(text) == quality_slowly(text)
    wide = np.arange(50) + 2**22  # numbers too large to pack three into one
    assert len(np.unique(quality.exact_windows(np.r_[wide, wide], 3))) == 50
    kept = quality.keep_good(corpus)
    assert kept.columns == corpus.columns and kept.count() == sum(quality.measure(t).kept for _, t in docs_of(corpus))
    assert quality.measure_quality(empty).count() == 0


def test_language(spark, corpus, empty):
    rows = language.identify(corpus).collect()
    assert len(rows) == corpus.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (6, 7, 8))
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(corpus.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letter_probabilities_add_up():
    import pandas as pd

    words = {"en": "the then there this that", "xx": "zzz zaz azz"}
    counts = collections.Counter()
    for lang, text in words.items():
        for word in text.split():
            padded = "   " + word + " "
            for k in range(len(padded) - 3):
                counts[lang, padded[k : k + 4]] += 1
    model = language.fit(pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "gram", "n"]))
    letters = range(len(model.letter_probs))
    for context in ([1, 1, 1], [1, 1, model.numbers[ord("t")]], [0, 0, 0], [model.numbers[ord("z")]] * 3):
        probs = model.probabilities(np.array([[*context, c] for c in letters]))
        assert np.allclose(probs.sum(axis=0), 1)
    # whole texts in numpy against one letter after the other, also when a text is read in several parts
    texts = ["", "12 - 3", "The then", "zaz, ZZZ!the\u00e9\u65e5 q", "this that " * 50]
    plain = []
    for text in texts:
        total = np.zeros(len(model.languages) + 1)
        for word in language.LETTERS.findall(text.lower()):
            numbers = [1, 1, 1, *(model.numbers[ord(c)] for c in word), 1]
            for k in range(len(numbers) - 3):
                total += [*np.log2(model.probabilities(np.array([numbers[k : k + 4]])))[0], 1]
        plain.append(total)
    assert np.allclose(model.text_scores(texts), plain)
    read, language.READ_CHARS = language.READ_CHARS, 7
    try:
        assert all("".join(language.cut_between_words(t)) == t for t in texts)
        assert np.allclose(model.text_scores(texts), plain)
    finally:
        language.READ_CHARS = read


def test_lm_scores_equal_plain_counts(corpus, empty):
    docs = docs_of(corpus)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 if i is not None else None
    tokens = [(i, [w.translate(LOWER) for w in WORDS.findall(t)] + ["\n"]) for i, t in docs]

    def count(parts):
        ones, twos = collections.Counter(), collections.Counter()
        for i, own in tokens:
            if fold(i) in parts:
                ones.update(own)
                twos.update(zip(["\n", *own[:-1]], own, strict=True))
        return ones, twos

    all_ones, all_twos = count(set(range(1, 10)))
    ones, twos = count(set(range(2, 10)))
    n, v = sum(ones.values()), len(ones)
    cells = collections.Counter()
    one_cell = lambda x: int(lm.cell_of(np.array([x]), 1 / (v + 1))[0])
    for i, own in tokens:
        if fold(i) == 1:
            for a, b in zip(["\n", *own[:-1]], own, strict=True):
                bucket = int(lm.bucket_of(np.array([ones[a]]))[0])
                cells[bucket, one_cell(twos[a, b] / max(ones[a], 1)), one_cell(ones[b] / n)] += 1
    weights = lm.learn_weights(np.array([(*k, c) for k, c in cells.items()], np.int64).reshape(-1, 4))
    total, vocabulary = sum(all_ones.values()), len(all_ones)
    want = collections.defaultdict(list)
    for i, own in tokens:
        base = sum(math.log10((all_ones[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in own)
        score = 0.0
        for a, b in zip(["\n", *own[:-1]], own, strict=True):
            w = weights[int(lm.bucket_of(np.array([all_ones[a]]))[0])]
            score += math.log10(w[0] * all_twos[a, b] / max(all_ones[a], 1) + w[1] * all_ones[b] / total + w[2] / (vocabulary + 1))
        want[i].append((fold(i) == 0, len(own), sum(all_ones[w] > 0 for w in own), total, base, score))
    # tiny batches and segments: many of both
    for settings in ({}, {"batch_bytes": 2000, "segment_tokens": 500}):
        got = collections.defaultdict(list)
        for r in lm.score_documents(corpus, **settings).collect():
            got[r.doc_id].append(tuple(r)[1:])
        assert got.keys() == want.keys()
        for i in want:
            for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
                assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)
    assert lm.score_documents(empty).count() == 0


def test_weights_follow_the_deleted_part():
    strong, weak = lm.cell_of(np.array([0.5, 0.0]), 1e-3)
    weights = lm.learn_weights(np.array([[3, strong, weak, 90], [3, weak, strong, 10]]))
    assert weights[3, 0] > 0.8 and np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0


def test_token_files(corpus, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in tokenfile.digest(tokenfile.round_trip(corpus)).collect()]
    docs = sorted(docs_of(corpus), key=lambda d: (d[0] is not None, d[0] or 0))
    expected = collections.Counter()
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((i, n, c) for i, _, n, c in got) == expected
    start = 0
    for i, at, n, _ in sorted(got, key=lambda r: r[1]):
        assert at == start
        start += n
    assert [g[0] for g in sorted(got, key=lambda r: r[1])] == [d[0] for d in docs]
    assert tokenfile.digest(tokenfile.round_trip(empty)).count() == 0


def test_variable_length_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = tokenfile.pack(values[:n])
        assert len(control) == -(-n // 4)
        assert tokenfile.unpack(control, data, n).tolist() == values[:n].tolist()


def test_bpe_equals_public_library(corpus, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines_:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines_)}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter(tuple(r) for r in bpe.digest(bpe.encode(corpus)).collect())
    want = collections.Counter()
    for i, text in docs_of(corpus):
        ids = np.array(public.encode_ordinary(text), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digest(bpe.encode(empty)).count() == 0


def test_mixing(corpus, empty):
    mixed = mixing.mix(corpus, block_words=200, shard_words=1000).collect()
    assert len(mixed) == corpus.count()
    by_source = collections.defaultdict(list)
    for r in mixed:
        by_source[r.source_row.source].append(r)
        assert r.size == len(WORDS.findall(r.source_row.text or "")) and len(r.shards) <= 3
    total = sum(r.size for r in mixed)
    assert math.isclose(sum(rows[0].target for rows in by_source.values()), total)
    for rows in by_source.values():
        largest = max(r.size for r in rows)
        taken = sum(r.size * len(r.shards) for r in rows)
        assert rows[0].source_size == sum(r.size for r in rows)
        assert abs(taken - rows[0].target) <= 2 * largest
        assert rows[0].target <= 3 * rows[0].source_size + 1e-9
    again = mixing.mix(corpus, block_words=200, shard_words=1000).collect()
    plain = lambda rows: sorted((str(r.source_row), list(r.shards)) for r in rows)
    assert plain(again) == plain(mixed)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_rows(mixing.mix(corpus))
    assert out.columns == corpus.columns and out.count() == sum(len(r.shards) for r in mixing.mix(corpus).collect())


def test_splitting_tree_keeps_quotas_and_halves(spark):
    quotas = spark.createDataFrame([([1000, 3, 0, 77],)], "quotas array<bigint>")
    leaves = mixing.splitting_tree(quotas, 3).collect()
    assert sorted(r.shard for r in leaves) == list(range(8))
    assert np.sum([r.quotas for r in leaves], axis=0).tolist() == [1000, 3, 0, 77]
    sizes = [sum(r.quotas) for r in leaves]
    assert max(sizes) - min(sizes) <= 1


def test_hypergeometric_draws_follow_their_law(spark):
    good, bad, draws = 30, 50, 20
    uniforms = [(k + 0.5) / 200 for k in range(200)]
    frame = spark.createDataFrame([(u,) for u in uniforms], "u double")
    lit = lambda x: F.lit(x).cast("bigint")
    got = [r.x for r in frame.select(mixing.hypergeometric(F.col("u"), lit(good), lit(bad), lit(draws)).alias("x")).collect()]
    ways = [math.comb(good, x) * math.comb(bad, draws - x) for x in range(draws + 1)]
    cdf = dict(enumerate(np.cumsum(ways) / math.comb(good + bad, draws)))
    assert sorted(got) == [next(x for x in sorted(cdf) if cdf[x] >= u - 1e-12) for u in uniforms]


def shingle_set(text):
    words = [w.translate(LOWER) for w in WORDS.findall(text)]
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def components_slowly(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_duplicates(spark, corpus, empty):
    # a chain and a star of near copies: neighbours are alike enough, ends are not
    words = [f"c{k}" for k in range(400)]
    extra = []
    for k in range(8):
        words = list(words)
        words[50 * k] = f"z{k}"
        extra.append((300 + k, " ".join(words)))
    docs = docs_of(corpus) + extra
    frame = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = components_slowly(sets, links)
    got = neardup.near_duplicates(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert neardup.near_duplicates(empty).count() == 0


def test_blocks_of_a_bucket_miss_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    draw = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for i in range(40):
        own = list(base)
        for k in draw.choice(120, draw.integers(1, 5), replace=False):
            own[k] = f"n{i}_{k}"
        docs.append((i, " ".join(own)))
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == components_slowly(sets, links)


def test_nearest_vectors(spark):
    draw = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in draw.normal(size=8)], 0) for k in range(600)]
    vectors += [(600 + k, vectors[20][1], 1) for k in range(300)]
    vectors += [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [None] * 8, 0), (1080, [], 0)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([v[0] for v in vectors[:900]])
    points = np.array([v[1] for v in vectors[:900]])
    hits = 0
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    for i, found in got.items():
        found.sort()
        scores = points @ points[np.flatnonzero(ids == i)[0]]
        scores[ids == i] = -np.inf
        best = ids[np.lexsort((ids, -np.round(scores, 9)))[:20]].tolist()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(math.isclose(f[2], scores[np.flatnonzero(ids == f[1])[0]], abs_tol=1e-12) for f in found)
        hits += len({f[1] for f in found} & set(best))
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(frame.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.search(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
