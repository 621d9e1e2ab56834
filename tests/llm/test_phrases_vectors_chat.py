"""Collocations, whitening and chat formatting: brute force, exact round trips, awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ratingspark.llm import chat_format, collocations, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 collocations

def brute_collocations(rows, min_count, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in often.items():
            if any(2 * f[q] >= a for q in often if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(5)
    words = ["new", "York", "City", "of", "the", "x", "日本", "\x00", "é\x1c"] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(
        rng.choice(words[:12] if rng.random() < .8 else words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  ", "."]) for _ in range(rng.randint(0, 200))))
        for _ in range(60)]
    rows += [("en", None), (None, None), ("fr", ""), ("en", "new York City " * 3000), ("es", " \n.,"), rows[3], rows[3]]
    return rows


def test_collocations_spill_before_a_task_is_large():
    """By default a task of 420,000 words spills; nothing is lost by it."""
    counter = collocations._Counter(collocations.LIMIT, collocations.BURST, None, 8)
    counter.count("en", [b" ".join(b"w%d" % i for i in range(420_000))], [1, 2])
    blocks = list(counter.spill())
    assert blocks and len(counter.ids) == 1 and not counter.tries
    rows = [part for block in blocks for data in block.column("block") for part in pa.ipc.open_stream(data.as_buffer())]
    assert sum(part.num_rows for part in rows) == 420_000 + 419_999 and counter.totals == {"en": 420_000}


@pytest.mark.parametrize("limit, burst", [(1_000_000, 4_096), (300, 4)])
def test_collocations_against_brute_force(spark, spoken, limit, burst):
    docs = spark.createDataFrame([(*r, 1, 0.5, "p", 7) for r in spoken], "lang string, text string, rank int, score double, phrase string, f int").repartition(3)
    for top, least in ((2_000, 10), (7, 2)):
        rows = collocations.collocations(docs, limit=limit, burst=burst, top=top, min_count=least).collect()
        assert {tuple(r) for r in rows} == brute_collocations(spoken, least, top)
    assert collocations.collocations(docs.filter("false")).count() == 0


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(0)
    trie, want = collocations.HatTrie(burst=8), Counter()
    for _ in range(20):
        ids = rng.integers(1, 9, 400)
        rows, counts = collocations.distinct_phrases(ids, np.arange(398), 3)
        trie.add(rows, counts)
        want.update(zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist()))
    assert isinstance(trie.root, collocations._Node) and trie.size == len(want)
    got, heads = Counter(), []
    for keep in (trie.size // 2, 0):
        for prefix, node in trie.take(keep):
            keys, numbers = [], []
            collocations._entries(prefix, node, keys, numbers)
            heads.append({k[:4] for k in keys})
            for key, number in zip(keys, numbers):
                got[tuple(np.frombuffer(key, ">u4").tolist())] += number
    assert got == want and trie.size == 0
    assert all(len(h) == 1 for h in heads[:-1]) and not set.union(*heads[:-1]) & heads[-1]


def test_bloom_filter_reaches_the_driver_in_segments(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 64)
    pairs = [("en", f"a{k} b{k % 7}") for k in range(3_000)]
    phrases = spark.createDataFrame(pairs, "lang string, phrase string").repartition(3)
    bits = 1 << 16
    rows = collocations.bloom_segments(phrases, 2, bits).collect()
    assert 1 < len(rows) <= bits // 64 // 64 and all(len(r.bits) == 8 * 64 for r in rows)
    got = np.frombuffer(collocations.bloom_filter(phrases, 2).value, np.uint64)
    want = np.zeros(bits // 64, np.uint64)
    salt = np.uint64(collocations.xxhash.xxh3_64_intdigest("en"))
    for _, phrase in pairs:
        words = np.array([collocations.xxhash.xxh3_64_intdigest(w) for w in phrase.encode().split()], np.uint64)
        for at in collocations._probes(collocations.phrase_hashes(words ^ salt, 2), bits):
            want[at >> np.uint64(6)] |= np.uint64(1) << (at & np.uint64(63))
    assert len(got) == bits // 64 and np.array_equal(got, want)
    assert not any(collocations.bloom_filter(phrases.limit(0), 2).value)


def test_longer_phrases_are_exact(spark, spoken):
    docs = spark.createDataFrame(spoken, "lang string, text string")
    rows = collocations.collocations(docs, longest=4, min_count=3, cover=1_000_000).collect()
    counts = Counter()
    for lang, text in spoken:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", " ".join(words[i:i + 4])) for i in range(len(words) - 3))
    got = {(r.lang, r.phrase): r.a for r in rows if r.phrase.count(" ") == 3}
    assert got == {k: v for k, v in counts.items() if v >= 3}


# 12 whitening

def vectors(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], 1, 0.5) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x double").repartition(3)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) - 3
    x[40:90] = x[40]
    inf = float("inf")
    extra = [(1000, None, None, None), (1001, [1.0, None] * 3, 1, 0.0), (1002, [float("nan")] * 6, 1, 0.0), (1003, [inf] * 6, 1, 0.0),
             (1004, [1.0] * 5, 1, 0.0), (1005, [], 1, 0.0), (None, x[7].tolist(), 1, 0.0), (7, x[7].tolist(), 1, 0.0)]
    table = vectors(spark, x, extra)
    model = whitening.fit(table)
    got = whitening.whiten(table, model).collect()
    grid = np.floor(256 * x).astype(int)
    points = np.unique(grid, axis=0)
    v = np.cov(points.T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    w = (grid - points.mean(axis=0)) @ axes[:, :4] / np.sqrt(values[:4])
    assert model.n == len(points) == 251 and len(got) == 4 * 302 and model.identity_error < 1e-9
    assert np.allclose(model.eigenvalues, values, rtol=1e-12)
    signs = np.sign((model.components[:4] * axes[:, :4].T).sum(axis=1))
    for r in got:
        at = 7 if r.vec_id is None else r.vec_id
        assert abs(r.whitened - w[at, r.component - 1] * signs[r.component - 1]) < 1e-9
        assert int(r.deviation) == sum((model.n * int(a) - int(s)) ** 2 for a, s in zip(grid[at], points.sum(axis=0)))
        assert abs(r.explained - values[r.component - 1] / v.trace()) < 1e-12


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 20, 2.0 ** 44, 1e300])
def test_whitening_is_exact_for_large_numbers(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) * scale
    table = vectors(spark, x)
    model = whitening.fit(table)
    limits = np.iinfo(np.int64)
    grid = [[max(limits.min, min(limits.max, int(np.floor(256 * c)))) for c in row] for row in x]
    points = sorted(set(map(tuple, grid)))
    n, sums = len(points), [sum(c) for c in zip(*points)]
    assert (model.n, model.sums) == (n, sums)
    for r in whitening.whiten(table, model, count=1).collect():
        exact = sum((n * a - s) ** 2 for a, s in zip(grid[r.vec_id], sums))
        assert (r.deviation is None and exact >= 10 ** 38) or int(r.deviation) == exact
    centred = [[(n * a - s) for a, s in zip(row, sums)] for row in points]
    v = np.array([[sum(row[i] * row[j] for row in centred) / n ** 3 for j in range(3)] for i in range(3)])
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(v)[::-1], rtol=1e-9) and abs(model.trace / v.trace() - 1) < 1e-12


def test_squares_in_limbs():
    for bits in (8, 19, 30, 45, 60):
        rng = np.random.default_rng(bits)
        s = rng.integers(-(1 << bits), 1 << bits, (200, 3))
        assert whitening.square_sums(s).tolist() == [sum(int(v) ** 2 for v in c) for c in s.T]


def test_whitening_without_variance(spark):
    same = vectors(spark, [[1.0, 2.0]] * 3)
    assert whitening.fit(same) is None and whitening.whiten(same, None).count() == 0
    assert whitening.fit(same.filter("false")) is None
    line = whitening.whiten(t := vectors(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]), whitening.fit(t)).collect()
    assert {r.component for r in line} == {1} and len(line) == 3


# 13 chat

BITS = ["[INST]", "[/INST]", "</s>", "<\\/s>", "[\\INST]", "[\\\\/INST]", "[TEXT]", " [TEXT] ", "[", "<", "/s>", "INST]", "é", "\\", " ", "x", "[ROLE]", "日本", "\n", "\x00"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv if conv % 17 else None, turn if turn != 3 else None, rng.choice(["user", "assistant", "system", "tool [INST]", None, ""]),
                         rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))]), "extra", 1))
    rows += [(500, k, "assistant", "long " * 2000 + f"[INST]{k}", None, None) for k in range(30)] + rows[:3]
    return rows


@pytest.mark.parametrize("slice_bytes", [10, 400, 4_000_000])
def test_chat_round_trip(spark, talks, slice_bytes):
    table = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, formatted string, part int").repartition(4)
    template = chat_format.Template()
    parts = chat_format.format_conversations(table, slice_bytes=slice_bytes)
    want = defaultdict(list)
    for conv, turn, role, text, *_ in talks:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    texts = defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: r.part):
        found = [(a.decode(), b.decode()) for a, b in chat_format.parse(template, r.formatted.encode())]
        spans = [chat_format.unescape(template, r.formatted[s.start:s.stop].encode()).decode() for s in r.loss]
        assert spans == [text for role, text in found if role == "assistant"] and len(found) == r.n_turns
        texts[r.conv_id] += found
    assert texts == {c: [x[2:] for x in sorted(rows)] for c, rows in want.items()}
    back = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    assert set(back) == set(want) and chat_format.read_back(parts).count() == len(want)
    for conv, rows in want.items():
        rows = sorted(rows)
        loss = "".join(x[3] for x in rows if x[2] == "assistant")
        assert (back[conv].n_turns, back[conv].loss_chars) == (len(rows), len(loss))
        assert back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()


def test_chat_parts_are_few_and_empty_tables(spark, talks):
    table = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, formatted string, part int")
    parts = chat_format.format_conversations(table)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.count() <= len({r[0] for r in talks}) + width - 1 and parts.filter("open").count() <= 2 * width
    assert chat_format.format_conversations(table.filter("false")).count() == 0
    assert chat_format.read_back(parts.filter("false")).count() == 0


def test_escaping_is_reversible_and_hides_controls():
    template, rng = chat_format.Template(), random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 20))).encode()
        hidden = chat_format.escape(template, text)
        assert chat_format.unescape(template, hidden) == text and not template.pattern(b"").search(hidden)


def test_texts_side_by_side_are_not_escaped_across():
    template = chat_format.Template()
    formatted, _ = chat_format.assemble(template, pa.array(["user", "user", "user"]), pa.array(["a [", "INST] b</", "s>"]), np.array([0]))
    assert formatted[0].as_py() == "[INST] a [ [/INST][INST] INST] b</ [/INST][INST] s> [/INST]"
