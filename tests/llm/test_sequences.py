"""Operators 11 to 13 against brute force on awkward rows."""

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbench.llm import packing, phrases, prefix_trie

# --- 11 ---------------------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, c long, m string, depth string"


def brute_trie(rows, h):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            x = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, x, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    trunc = lambda c: int(np.fix(c / 5)) * 5
    whole = {c: tuple(own.get(trunc(c), [])[: h(c)] + t[h(c) :]) for c, t in own.items()}
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = set()
    for key, who in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = lambda k: [x for x in members if len(x) == len(k) + 1 and x[:-1] == k]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        out.add((min(who), len(key), parent, len(who), len(kids(key)), sum(not kids(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def talk(seed, n):
    rng = np.random.default_rng(seed)
    texts = ["a", "b", "é", "", None]
    rows = [(int(c), int(t), ["user", "assistant", None][rng.integers(3)], texts[rng.integers(5)], 1, "x", "y") for c in range(-7, n) if c % 7 for t in range(rng.integers(1, 6))]
    rows += [(40, None, "user", "a", 1, "x", "y")] * 3 + [(41, 0, "user", "a", 1, "x", "y")] * 12 + [(None, 0, "user", "z", 1, "x", "y"), (1003, 0, "user", "q", 1, "x", "y")]
    for c in range(100, 130):  # a large group of copies
        rows += [(c, t, "user", "copy", 1, "x", "y") for t in range(4)]
    return rows


@pytest.mark.parametrize(("piece", "shard"), [(prefix_trie.PIECE, prefix_trie.SHARD), (3, 10)])
def test_prefix_trie(spark, piece, shard):
    rows = talk(piece, 60)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).repartition(3), piece=piece, shard=shard).collect()
    want = brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 9)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_prefix_trie_own_prefix(spark):
    rows = talk(5, 30)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK), prefix=F.lit(2), piece=4, shard=50).collect()
    assert {tuple(r) for r in got} == brute_trie(rows, lambda c: 2)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    lone = prefix_trie.prefix_trie(spark.createDataFrame([(1003, 0, "user", "q", 1, "x", "y")], TALK)).collect()
    assert {tuple(r) for r in lone} == brute_trie([(1003, 0, "user", "q")], lambda c: zlib.crc32(str(c).encode()) % 9)


def test_slots():
    g = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    slots = prefix_trie.Slots(np.concatenate([g, g[:100]]))
    found = slots.find(g)
    assert slots.size == 5000 and sorted(found) == list(range(5000)) and (slots.digests[found] == g).all()
    with pytest.raises(ValueError, match="no slot"):
        slots.find(np.full((1, 2), 7, np.uint64))
    assert prefix_trie.Slots(g[:0]).find(g[:0]).tolist() == []


def test_accumulate_refuses_a_shared_digest():
    g = np.array([[1, 1], [2, 2], [1, 1]], np.uint64)
    with pytest.raises(ValueError, match="share"):
        prefix_trie.accumulate(np.array([0, 0, 1]), np.array([2, 1, 3]), g, np.ones((3, 1), np.int64))


# --- 12 ---------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, h1 string, z string, f long, rank long"


def brute_phrases(rows, least, share, top):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts[lang or "und" if lang != "" else ""].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inner = Counter()
        for g, a in found.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inner[g[i : i + m]] = max(inner[g[i : i + m]], a)
        own = []
        for g, a in found.items():
            score, k = min(((2000000 * a) // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * inner[g] < share * a:
                own.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(4)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "x-y", "ein", " ", "long" * 200, "and"]
    p = np.array([9, 3, 8, 3, 3, 3, 1, 1, 1, 1, 0.2, 6])
    rows = []
    for i in range(150):
        w = rng.choice(vocabulary, rng.integers(0, 40), p=p / p.sum())
        gaps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "; ", "\x85"], len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.03, 0.02])
        rows.append((i, "".join(a + b for a, b in zip(w, gaps)), ["en", "de", None, "und"][i % 4], "a", "b", 1, 1))
    rows += [(200, None, "en", "a", "b", 1, 1), (201, "", "xx", "a", "b", 1, 1), (202, " ,. \t", "en", "a", "b", 1, 1), (None, "of the new york city of the", "en", "a", "b", 1, 1)]
    rows += [(300, "boil er plate text here now and then. ", "en", "a", "b", 1, 1)] * 60
    return rows + [(301, "very long " * 20000, "fr", "a", "b", 1, 1)]


@pytest.mark.parametrize(("least", "share", "top", "budget"), [(5, 80, 2000, 1 << 20), (3, 50, 25, 40), (30, 80, None, 7)])
def test_collocations(spark, least, share, top, budget):
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least, share, top, budget).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, least, share, top)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", "", 1, 1), (2, "a b", "en", "", "", 1, 1)], DOCS)).count() == 0


def test_a_bitmap_that_is_full_changes_nothing(spark, monkeypatch):
    from textbench.llm import shared

    monkeypatch.setattr(shared, "MAX_BITS", 64)
    rows = phrase_rows()[:60]
    got = phrases.collocations(spark.createDataFrame(rows, DOCS), 5).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 5, 80, 2000)


# --- 13 ---------------------------------------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for v in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, v)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > v:
            bisect.insort(gaps, gap - v)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(20, 200))
    lengths = rng.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(rng.geometric(0.08, 3000), capacity)
    counts = {int(v): int(n) for v, n in Counter(lengths.tolist()).items()}
    rows = packing.plan(counts, capacity)
    fill = defaultdict(list)
    for v, lo, hi, q, first, before in rows.tolist():
        for i in range(hi - lo):
            fill[first + i // q].append((before + i % q * v, v))
    taken = Counter(v for own in fill.values() for _, v in own)
    assert taken == Counter(lengths.tolist())
    for own in fill.values():
        at = 0
        for offset, v in sorted(own):
            assert offset == at
            at += v
        assert at <= capacity
    assert len(fill) == best_fit(lengths.tolist(), capacity)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def texts():
    rng = np.random.default_rng(8)
    alphabet = list("abcXYZ  \n\t'sdé½²0123.,;-_ÿ×  \x85…’") + ["don't", " the", "\r\n", "   "]
    return ["".join(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(300)]


def test_words_give_the_tokenizers_ids(tokenizer, monkeypatch):
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    hard = [*texts(), "", "中文 и русский", "a<|endoftext|>b", "​ zero", "it's we'll I'D", "x" * 5000, "\x1c\x1d a\x1f", " \n \n  a", "end  "]
    for t in hard:
        assert encode(t) == packing.packed(tokenizer, t), t
    monkeypatch.setattr(packing, "STRETCH", 7)
    monkeypatch.setattr(packing, "KEPT", 5)
    for t in hard:
        assert encode(t) == packing.packed(tokenizer, t), t


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_sequences(spark, tokenizer, capacity):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "null id", "x", 1), (5, "again", "x", 1), (5, "again", "x", 1), (400, None, "x", 1), (401, "", "x", 1), (402, "word " * 9000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(3)
    got = packing.pack_sequences(docs, capacity=capacity).collect()
    want, lengths = Counter(), []
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lengths.append(hi - lo)
    assert Counter(tuple(r)[:5] for r in got) == want
    own = defaultdict(list)
    for r in got:
        own[r.sequence_id].append((r.offset, r.length))
    for parts in own.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(own) == best_fit(lengths, capacity)
    assert packing.pack_sequences(docs.limit(0)).count() == 0
