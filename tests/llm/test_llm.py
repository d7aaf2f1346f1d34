"""Each operator against brute force on awkward rows: nulls, empty and long texts, copies, repeated rows, clashing columns, no rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import common, decontamination, hilbert_sharding, language_id, packing, quality_rules, simhash, sstable, substring_dedup, tokens, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, score string, v string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 6))) for _ in range(400)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward():
    passage = prose(60, "passage")
    texts = [None, "", " \n\t ", "a", "short one", prose(3000, 1), prose(120, 2), prose(120, 2)]
    texts += [f"{prose(30, i)} {passage} {prose(30, 100 + i)}" for i in range(3, 12)]
    texts += [f"{passage} {passage}", " ".join(["same"] * 100), "\n".join(["a line of words that is here again and again"] * 12), "x\u00a0y \u2003z\u0085w", "\x1c\x1d <|endoftext|> a  b\n c "]
    texts += [texts[10]] * 70
    rows = [(i * 3 + 1, t, None if i % 5 == 0 else ("en", "fr")[i % 2], f"src{i % 3}", None if t is None else len(t), 1, "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "no id at all here", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, none):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first, want = {}, collections.Counter()
    for i, t in rows:
        w = words_of(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup.substring_dedup(docs)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert sum(n for (_, _, removed, _), n in want.items() if removed) > 70
    assert substring_dedup.substring_dedup(none).count() == 0


def test_shared_tiles_in_unlike_passages(spark):
    """A tile's words may stand in several passages; each of their windows is still found."""
    tile = prose(12, "tile")
    texts = [f"{prose(15, a)} {tile} {prose(15, b)}" for a, b in itertools.product(range(20, 24), range(30, 34))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[::-1])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert all(got[i][0] == got[i][1] for i in range(len(texts), 2 * len(texts)))


def test_hilbert(docs, none):
    side = range(4)
    index = {hilbert_sharding.hilbert_index(c, 2): c for c in itertools.product(side, side, side)}
    assert sorted(index) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(index[i], index[i + 1], strict=True)) == 1 for i in range(63))
    rows = hilbert_sharding.hilbert_shards(docs).collect()
    given = docs.collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in shards.values())
    assert all(max(x.curve for x in shards[i]) <= min(x.curve for x in shards[i + 1]) for i in range(15))
    assert hilbert_sharding.hilbert_shards(none).count() == 0


def test_hilbert_levels_and_pruning(spark):
    """row -> levels of whole strings -> cell -> curve, by brute force; shards have narrow ranges, so a filter skips most."""
    r = random.Random(8)
    rows = [(i, "x" * int(r.expovariate(0.02)), r.choice(["de", "en", "en", "fr", None]), None if i % 50 == 0 else "https://site%d.org" % (0 if r.random() < 0.3 else r.randrange(300))) for i in range(3000)]
    got = {x.doc_id: x for x in hilbert_sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    dims = [[len(t) + 1 for _, t, _, _ in rows], [x or "" for _, _, x, _ in rows], [s or "" for *_, s in rows]]
    cuts = []
    for values in dims:
        ordered = sorted(values)
        cuts.append(sorted({ordered[-(-i * 3000 // 16) - 1] for i in range(1, 16)}))
    levels = [tuple(sum(c < v for c in cut) for cut, v in zip(cuts, x, strict=True)) for x in zip(*dims, strict=True)]
    assert all(got[i].curve == hilbert_sharding.hilbert_index(x) for i, x in enumerate(levels))
    assert len({x[2] for x in levels}) > 10  # sources with a common beginning keep their dimension

    def read(of, value):  # shards whose minimum and maximum let the value through
        by = collections.defaultdict(list)
        for i in range(3000):
            by[got[i].shard].append(dims[of][i])
        return sum(min(x) <= value <= max(x) for x in by.values())

    assert np.mean([read(2, f"https://site{i}.org") for i in range(1, 300)]) < 9
    assert np.mean([read(0, n) for n in range(1, 200, 5)]) < 14


def test_crf(spark, none):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 80))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["zounds", "blasted", "zounder"]))
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    long = " ".join(r.choice(WORDS) for _ in range(30_000)) + " blasted"
    extra = [(998, None), (999, ""), (1000, long), (None, "zounds"), rows[0], rows[0]]
    df, labels = spark.createDataFrame([(*x, 7.0, "z") for x in [*rows, *extra]], "doc_id long, text string, score double, spans string"), spark.createDataFrame([*marks, (None, 1), (5, None), marks[0]], "doc_id long, toxic int")
    all_rows = toxicity.toxicity(df, labels).collect()
    assert len(all_rows) == 406 and len({(x.score, x.predicted, str(x.spans)) for x in all_rows if x.doc_id == 0}) == 1
    assert next(x for x in all_rows if x.doc_id is None).held_out is False
    assert [long[s.start : s.end] for s in next(x for x in all_rows if x.doc_id == 1000).spans] == ["blasted"]
    found = {x.doc_id: x for x in all_rows if x.doc_id is not None and x.doc_id < 1000}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in found.items())
    held = [(found[i].predicted, t) for i, t in marks if found[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(found) == 402
    text = dict(rows)[0]
    assert {text[s.start : s.end].split()[0] for s in found[0].spans} <= {"zounds", "blasted", "zounder"} and found[0].spans
    assert toxicity.toxicity(none.select("doc_id", "text"), labels.limit(0)).count() == 0


def test_crf_marginals_by_enumeration():
    r = np.random.default_rng(1)
    s, trans = r.normal(0, 1, 7), r.normal(0, 1, (2, 2))
    total, by = 0.0, np.zeros(7)
    for tags in itertools.product((0, 1), repeat=7):
        p = np.exp(sum(s[i] for i, t in enumerate(tags) if t) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
        total += p
        by += p * np.array(tags)
    assert np.allclose(toxicity.marginals(s, np.array([0]), np.array([7]), trans), by / total)


def test_packing(docs, none):
    library = tokens.encoder(tokens.default_path()).tokenizer
    given = docs.collect()
    ids = [np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in given]
    pieces = packing.pack(docs, window=64).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    rows = {r.doc_id: i for r, i in zip(given, ids, strict=True)}
    for p in pieces:
        own = rows[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(rows[p.doc_id]) and p.ids == own.tolist() and p.ids_crc32 == zlib.crc32(own.tobytes())
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    ends = []
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        ends.append(at)
    assert max(ends) <= 64 and sum(e < 64 for e in ends) <= 4  # one a shard
    assert packing.pack(none).count() == 0


def _stream(docs):
    return np.concatenate(docs), np.array([len(d) for d in docs])


def _bm25(docs, idf, seed, d, mean):
    """By the formula: the seed's terms that stand in more than one document."""
    total = 0.0
    for t in set(docs[seed].tolist()):
        if (n := (docs[d] == t).sum()) and sum(t in x for x in docs) > 1:
            total += idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
    return total


def test_bm25_by_brute_force():
    r = np.random.default_rng(2)
    docs = [np.sort(r.integers(0, 60, r.integers(5, 15))).astype(np.uint16) for _ in range(80)]
    docs += [np.concatenate([d, r.integers(60, 400, 30).astype(np.uint16)]) for d in docs[:20]]  # frequent terms and rare ones
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf, mean = np.log1p((100 - df + 0.5) / (df + 0.5)).astype(np.float32), np.mean([len(d) for d in docs])
    assert (df >= packing.DENSE).any() and ((df > 1) & (df < packing.DENSE)).any()
    index, used = packing.Index(*_stream(docs), idf, mean), np.zeros(100, bool)
    used[[3, 50]] = True
    for seed in range(0, 100, 7):
        want = [0 if used[d] else _bm25(docs, idf, seed, d, mean) for d in range(100)]
        assert np.allclose(index.neighbours(seed, used), want, rtol=1e-4, atol=1e-6)


def test_packing_order_by_brute_force():
    """The greedy rule, told plainly: each window takes its seed's best unused neighbours by all terms, then the next in key order."""
    r = np.random.default_rng(6)
    docs = [np.sort(np.concatenate([np.arange(i % 3 * 40, i % 3 * 40 + 40), r.integers(120, 300, r.integers(1, 40))])).astype(np.uint16) for i in r.permutation(60)]
    docs += [np.array([500 + i], np.uint16) for i in range(5)]  # without a neighbour
    docs = [docs[i] for i in r.permutation(len(docs))]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=600)
    idf, mean = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32), np.mean([len(d) for d in docs])
    for window in (64, 280):
        order, at, left, seed = [], 0, list(range(len(docs))), None
        while left:
            if at % window == 0:
                seed = None
            elif at // window != (at - len(docs[order[-1]])) // window:
                seed = order[-1]
            score = {d: _bm25(docs, idf, seed, d, mean) if seed is not None else 0 for d in left}
            pick = max(left, key=lambda d: (round(score[d], 4), -d))
            left.remove(pick)
            seed = pick if at % window == 0 else seed
            order.append(pick)
            at += len(docs[pick])
        assert packing.packed_order(*_stream(docs), idf, mean, window) == order


def test_packing_over_many_shards(spark, monkeypatch):
    """Shards of few documents, a hot key, null and repeated ids: every id in one piece, windows full."""
    monkeypatch.setattr(packing, "DOCS", 7)
    rows = [(None if i % 9 == 0 else i // 2, prose(i % 60, i % 20) if i % 3 else prose(40, "hot")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, window=64).toPandas()
    assert sorted(pieces[pieces.start == 0].doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in rows)
    size = pieces.groupby("sequence_id").length.sum()
    assert size.max() == 64 and (size < 64).sum() <= 4
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == np.concatenate([[0], s.length.cumsum()[:-1]])).all()


def _fingerprint(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, none):
    rows = docs.collect()
    fps = [_fingerprint(r.text) for r in rows]
    roots = _components(fps)
    ids = collections.defaultdict(list)
    for r, c in zip(rows, roots, strict=True):
        ids[c].append(r.doc_id)
    want = collections.Counter((r.doc_id, f"{f:016x}", min((i for i in ids[c] if i is not None), default=None)) for r, f, c in zip(rows, fps, roots, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_with_hot_keys(spark, bits):
    """Hundreds of fingerprints that share a chain, a dense ball among them: the same components as all pairs give."""
    r = random.Random(bits)
    base = r.getrandbits(64)
    near = {base ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(40, 64)} | {base ^ r.getrandbits(24) for _ in range(200)}
    fps = sorted(near | {r.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"), bits)
    got = {r.node: r.label for r in simhash.components(links).collect()}
    want = collections.defaultdict(set)
    seen = set()
    for f in fps:
        if f in seen:
            continue
        todo, own = [f], {f}
        while todo:
            x = todo.pop()
            more = {y for y in fps if (x ^ y).bit_count() <= bits} - own
            own |= more
            todo += more
        seen |= own
        for x in own:
            want[x] = own
    for f, s in zip(fps, signed, strict=True):
        least = min(x - (1 << 64) if x >> 63 else x for x in want[f])
        assert got.get(s, s) == least


def test_similar_groups(spark, docs, none):
    base = prose(300, "base").split()
    edited = list(base)
    edited[20], edited[150], edited[280] = "one", "two", "three"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base)), (4, prose(300, "other")), (5, " ".join(base[:150] + prose(150, "x").split())), (6, None), (7, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6}
    assert simhash.similar_groups(none).count() == 0


def test_similar_rows_by_fingerprint(spark, docs):
    """What SimHash links, near_duplicates or similar_rows, is one group, also where sets of shingles are unlike."""
    phrase = prose(31, "phrase")
    rows = [(i, f"{' '.join([phrase] * 40)} {prose(12, f'end {i}')}") for i in range(4)] + [(9, prose(200, "apart"))]
    df = spark.createDataFrame([*rows, *((i, (prose(9, "start") + " " + t)) for i, t in [(20, prose(300, "x")), (21, prose(300, "x"))])], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows[:2])]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    root = {r.doc_id: r.root for r in simhash.similar_rows(df).collect()}
    assert len({root[i] for i in range(4)}) == 1 and root[9] not in {root[0], root[20]} and root[20] == root[21]
    for table in (df, docs.where("doc_id IS NOT NULL")):
        roots = collections.defaultdict(set)
        component = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
        for r in simhash.similar_rows(table).collect():
            roots[component[r.doc_id]].add(r.root)
        assert all(len(found) == 1 for found in roots.values())


def _jaccard_components(texts, n=5, limit=0.8):
    """Sets of places, by comparing all pairs on all shingles."""
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (t.lower().split() for t in texts)]
    todo, found = set(range(len(sets))), set()
    while todo:
        own = new = {min(todo)}
        while new:
            todo -= new
            new = {j for j in todo if any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= limit for i in new)}
            own = own | new
        found.add(frozenset(own))
    return found


def _similar(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    by = collections.defaultdict(set)
    for i in range(len(texts)):
        by[label.get(i, i)].add(i)
    return set(map(frozenset, by.values()))


def test_graded_group_and_version_chain(spark):
    """Copies edited each on its own, and versions each edited from the last: the least id is like few of them."""
    r, base = random.Random(12), [f"w{i}" for i in range(300)]
    texts, version = [], list(base)
    for i in range(80):
        copy = list(base)
        for at in r.sample(range(300), 2 + i % 3):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    for i in range(60):
        version = list(version) if i else [f"v{i}" for i in range(300)]
        for at in r.sample(range(300), 4):
            version[at] = f"e{i}x{at}"
        texts.append(" ".join(version))
    r.shuffle(texts)
    assert _similar(spark, texts) == _jaccard_components(texts)


def test_template_group_in_rounds(spark, monkeypatch):
    """Pages of one template, similar and not, whose keys hold more nodes than a round has hubs; members dealt in small parts."""
    monkeypatch.setattr(simhash, "HUBS", (1, 3))
    monkeypatch.setattr(simhash, "FAN", 5)
    r, texts = random.Random(13), []
    for i in range(70):
        own = [f"t{j}" for j in range(200)]
        for at in r.sample(range(0, 200, 5), r.choice((1, 3, 3, 4))):
            own[at] = f"o{r.randrange(40)}"
        texts.append(" ".join(own + [f"own{i % 50}x{j}" for j in range(r.choice((0, 15, 25)))]))
    want = _jaccard_components(texts)
    assert len(want) > 3 and max(map(len, want)) > 10
    assert _similar(spark, texts) == want


def test_blocks_of_a_large_key(spark, monkeypatch):
    """A text goes to a key's blocks, not to each pair; every hub meets every member once."""
    monkeypatch.setattr(simhash, "FAN", 20)
    rows = [(1, n, n, 90) for n in range(90)] + [(2, n, 0, 3) for n in (5, 6, 7)]
    members = spark.createDataFrame(rows, "key long, node long, label long, size long")
    for most in (7, 90):
        placed = simhash._placed(members, most).collect()
        assert sum(r.key == 1 for r in placed) <= 2 * 90 * -(-90 // 20)
        assert sorted(r.node for r in placed if r.key == 2 and r.hub and r.member) == [5, 6, 7]
        blocks = collections.defaultdict(lambda: ([], []))
        for r in placed:
            for side, own in zip(blocks[r.key, r.i, r.j], (r.hub, r.member), strict=True):
                side += [r.node] * own
        met = collections.Counter((k, a, b) for (k, *_), (hubs, own) in blocks.items() for a in hubs for b in own)
        hubs = {(r.key, r.node) for r in placed if r.hub}
        assert set(met) == {(k, a, n) for k, a in hubs for key, n, *_ in rows if key == k} and set(met.values()) == {1}
        assert len(hubs) == 93 if most == 90 else len(hubs) > 3


def test_alike_by_sets(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    r = random.Random(5)
    sets = [set(r.sample(range(40), r.randint(20, 40))) for _ in range(50)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = set(zip(*(x.tolist() for x in simhash._alike(arrays[:15], arrays[15:], 0.6)), strict=True))
    want = {(i, j) for i in range(15) for j in range(35) if len(sets[i] & sets[15 + j]) / len(sets[i] | sets[15 + j]) >= 0.6}
    assert got == want and 0 < len(want) < 525


def test_long_texts_near_the_limit(spark):
    """Pairs of 1500 words just over and just under the similarity: decided on all shingles, not on a sample."""
    r, texts = random.Random(21), []
    for i, edits in enumerate(range(28, 44)):
        words = [f"p{i}w{j}" for j in range(1500)]
        texts.append(" ".join(words))
        for at in r.sample(range(0, 1490, 6), edits):
            words[at] = f"p{i}e{at}"
        texts.append(" ".join(words))
    want = _jaccard_components(texts)
    assert 16 < len(want) < 32
    assert _similar(spark, texts) == want


def test_quality(docs, none):
    for r in docs.join(quality_rules.repetition_quality(docs).withColumnRenamed("score", "q"), "doc_id").collect():
        w, text = words_of(r.text), r.text or ""
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        own = [x for x in text.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r.kept and r.base_failed)
        later = set()
        seen = set()
        for i in range(len(w) - 9):
            later |= set(range(i, i + 10)) if tuple(w[i : i + 10]) in seen else set()
            seen.add(tuple(w[i : i + 10]))
        assert r.dup_10gram_chars == sum(len(w[i]) for i in later)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.repetition_quality(none).count() == 0 == quality_rules.accepted(none).count()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/1?x#y", "https://a.b.net", "https://a.b.net/x", "http://x.org/fr/", "http://spam-farm.example.org/en/", "http://notnet/", "http://example.com/de/é", "x://h?//", "http://CHEAP-PILLS.example.com", "http://s.xxx/a", "http://e.com/" + "a" * 5000]
    given = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    rows = url_filters.url_verdicts(given).orderBy("page_id").collect()
    assert url_filters.url_verdicts(given.unionAll(given)).count() == 2 * len(urls) and url_filters.url_verdicts(given.limit(0)).count() == 0
    assert [(r.host, r.rule, r.verdict) for r in rows] == [
        ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("example.net", "example.net/en/", "allow"), ("a.b.net", None, "allow"), ("a.b.net", "net/", "block"), ("x.org", "org/fr/", "allow"),
        ("spam-farm.example.org", None, "block"), ("notnet", None, "allow"), ("example.com", "example.com/de/", "block"), ("h", None, "allow"), ("cheap-pills.example.com", None, "block"), ("s.xxx", None, "block"), ("e.com", None, "allow"),
    ]


def test_shift_and_by_fnmatch():
    r = random.Random(3)
    globs = ["".join(r.choice("ab*?") for _ in range(r.randint(1, 30))) for _ in range(20)]
    for some in ([g] for g in globs):
        rule = re.compile("".join({"*": ".*", "?": "."}.get(c, c) for c in some[0]), re.S)
        texts = ["".join(r.choice("abbaé漢") for _ in range(r.randint(0, 12))).encode() for _ in range(200)]
        assert url_filters.ShiftAnd(some).matches(texts).tolist() == [bool(rule.fullmatch(t.decode())) for t in texts]
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))).encode() for _ in range(200)]
    each = np.any([url_filters.ShiftAnd([g]).matches(texts) for g in globs], axis=0)
    assert url_filters.ShiftAnd(globs).matches(texts).tolist() == each.tolist()


def test_url_rules_by_all_rules():
    r = random.Random(4)
    names = [".".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(30)]
    rules = list({n + "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3))): r.choice(("allow", "block")) for n in names}.items())
    rules, known = [(v, k) for k, v in rules], None
    known = url_filters.Rules(rules)
    for _ in range(2000):
        host, path = ".".join(r.choice("abc") for _ in range(r.randint(1, 4))), r.choice(("", "/" + "".join(r.choice("xy/") for _ in range(3))))
        fits = [(-len(k), i, k, v) for i, (v, k) in enumerate(rules) for n, _, p in [k.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
        assert known.of(host, path) == (min(fits)[2:] if fits else (None, None))


def test_sstable(docs, none, tmp_path):
    library = tokens.encoder(tokens.default_path()).tokenizer
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]
    at, want = 0, collections.Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    files = sstable.write_shards(docs, str(tmp_path)).cache()
    assert collections.Counter(tuple(r) for r in sstable.read_shards(files, str(tmp_path)).collect()) == want
    import pyarrow.fs as fs

    opened = [sstable.Table(fs.LocalFileSystem().open_input_file(r.path)) for r in files.collect()]
    for i, t in rows[::9]:
        found = [x for table in opened if (x := table.get(i)) is not None]
        assert any(x.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2] for x in found)
    assert all(table.get(-5) is None and table.get(2) is None for table in opened)
    assert sstable.token_table(none).count() == 0


def test_encoder_on_white_space_and_signs():
    e = tokens.encoder(tokens.default_path())
    r = random.Random(11)
    texts = ["".join(r.choice([" ", "  ", "\n", "\t", "a", "Bé", "don't", "12", "!?", "\u00a0", "\u2003", "漢", "😀", "<|endoftext|>", "x.", ","]) for _ in range(r.randint(0, 25))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_keeps_lines_apart():
    """A line's last word and the next line's first are cached each on its own, and a space before a line's end is not taken for one."""
    e = tokens.Encoder(tokens.default_path())
    e.encode("one two.\nThree four,\nfive six")
    assert {"two.", "\nThree", "\nfive"} <= set(e.pieces)
    for t in ["one two.\nThree four,\nfive", "six \nThree", "six\n Three", "\nThree", "a\n\nThree b\nThree", "a\n", "a\n\n\nb c\r\nd", "é\né \n é"]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_decontamination(spark, docs, none):
    for size in range(1, 41):  # whatever the substitutions that are allowed, a seed is left
        window = min(15, size)
        masks = next(masks for least, most, masks in decontamination.FAMILIES if least <= size <= most)
        for places in itertools.combinations(range(window), window - -(-4 * window // 5)):
            assert any(not set(places) & {o + j for j in m} for m in masks for o in range(window - m[-1])), (size, places)
    item = prose(30, "item").split()
    changed = list(item)
    changed[3], changed[9], changed[20] = "one", "two", "three"
    rows = [(1, f"{prose(40, 'a')} {' '.join(item)} {prose(40, 'b')}"), (2, f"{prose(40, 'c')} {' '.join(changed)}"), (3, prose(200, "d")), (4, " ".join(item[:8])), (5, " ".join(item[10:27]).upper() + "."), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item), 1), (10, None, 1), (11, "too short", 1), (None, "x", 1), (12, "", 1)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()) == [(1, 9), (2, 9), (5, 9)]
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [3, 4, 6, 7]
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.contaminated(none, bench).count() == 0


def _alignments(words, item):
    """Brute force: over all alignments, (matched, overlap, -start) of the best window, or None."""
    best, window = None, min(15, len(item))
    for start in range(1 - len(item), len(words)):
        same = [0 <= start + j < len(words) and words[start + j] == x for j, x in enumerate(item)]
        matched = max(sum(same[a : a + window]) for a in range(len(item) - window + 1))
        if 5 * matched >= 4 * window:
            best = max(best or (0,), (matched, sum(same), -max(start, 0)))
    return best


def test_contamination_by_all_alignments(spark, monkeypatch):
    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    items = [(None if i == 7 else i, [r.choice(words) for _ in range(1 + i % 40)]) for i in range(60)]
    items += [(200, ["same"] * 20), (201, ["same"] * 3), (3, items[3][1]), (202, [f"t{i}" for i in range(15)] + ["a"]), (203, [f"t{i}" for i in range(15)] + ["b"])]
    docs = [(i, [r.choice(words) for _ in range(r.randint(0, 12))]) for i in range(40)]
    for i, (_, item) in enumerate(items):  # excerpts with substitutions, at the edges of documents too
        a = r.randint(0, max(0, len(item) - 15))
        part = [x if r.random() > 0.15 else r.choice(words) for x in item[a : a + r.randint(10, 25)]]
        docs.append((100 + i, [r.choice(words) for _ in range(r.choice((0, 5)))] + part + [r.choice(words) for _ in range(r.choice((0, 5)))]))
    docs += [(500, ["same"] * 60), (None, items[30][1]), (100, items[30][1]), (100, items[30][1])]
    want = collections.Counter()
    for d, text in docs:
        for i, item in items:
            if best := _alignments(text, item):
                want[d, i, -best[2], best[0], min(15, len(item)), best[1]] += 1
    bench = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in items], "item_id long, text string")
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    for parts in (1, 7):
        assert collections.Counter(map(tuple, decontamination.contaminated(rows.repartition(parts), bench).collect())) == want
    clean = collections.Counter(x.doc_id for x in decontamination.clean(rows, bench).collect())
    assert clean == collections.Counter(d for d, t in docs if not any(_alignments(t, item) for _, item in items))
    monkeypatch.setattr(decontamination, "PART", 20)  # several parts, one after the other
    assert collections.Counter(map(tuple, decontamination.contaminated(rows, bench).collect())) == want
    assert collections.Counter(x.doc_id for x in decontamination.clean(rows, bench).collect()) == clean


def test_excerpt_of_a_long_item_among_short_documents(spark):
    """The alignment starts in an earlier document that has an equal token, its middle and end lie in later ones."""
    item = [f"i{j}" for j in range(500)]
    texts = [" ".join([*(f"d{i}x{j}" for j in range(25)), "i20", *item[:60:3], *(f"d{i}y{j}" for j in range(14))]) for i in range(12)]
    texts[5] = " ".join([*(f"q{j}" for j in range(5)), *item[150:200], *(f"r{j}" for j in range(5))])
    texts[3] = "i25 " + texts[3].split(" ", 1)[1]  # stands where the alignment of texts[5] has it
    alone = spark.createDataFrame([(5, texts[5])], "doc_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = [tuple(r) for r in decontamination.contaminated(alone, bench).collect()]
    assert [r[:2] for r in want] == [(5, 1)]
    assert [tuple(r) for r in decontamination.contaminated(df, bench).collect()] == want
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [i for i in range(12) if i != 5]


def test_language(spark, docs, none):
    r = random.Random(4)
    kinds = {"aa": ["tha", "ing", "er", "wh"], "bb": ["ção", "eau", "ou", "que"]}
    rows = [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), k) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    long = " ".join(r.choice(kinds["bb"]) + r.choice(kinds["bb"]) for _ in range(30_000))
    odd = [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "½ ² Ⅷ", "aa"), (904, long, None), (905, "eauou", None), (None, "thaing er", None), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, 1, "z") for x in [*rows, *odd]], "doc_id long, text string, lang string, score int, held_out string")
    found = language_id.identify(df).collect()
    by = {x.doc_id: x for x in found}
    assert len(found) == 300 + len(odd) and all(0 <= x.score <= 1 for x in found)
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4
    assert by[904].lang_pred == by[905].lang_pred == "bb" and by[None].lang_pred == "aa" and not by[None].held_out
    assert len({(x.lang_pred, x.score) for x in found if x.doc_id == 0}) == 1
    held = [(by[i].lang_pred, k) for i, _, k in rows if by[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert language_id.identify(none).count() == 0
    assert {x.lang_pred for x in language_id.identify(docs.drop("lang").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gru_gradients():
    model = language_id.BiGru(["a", "b", "c"], hidden=4)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pieces, y = [b" ab ", b" abcde ", b"x"], np.array([0, 1, 2])
    _, grads = model.gradients(pieces, y)
    for name, w in model.w.items():
        flat = np.argwhere(np.abs(grads[name]) > 1e-4)
        for at in flat[:: max(1, len(flat) // 5)][:5]:
            at, old = tuple(at), w[tuple(at)]
            w[at] = old + 1e-5
            up = model.gradients(pieces, y)[0]
            w[at] = old - 1e-5
            down = model.gradients(pieces, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 2e-3, name


def test_gru_by_a_plain_pass():
    """Windows in step give what one cell after the other gives."""
    model, r = language_id.BiGru(["a", "b", "c"]), random.Random(3)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 40, 448, 449, 1500)] + [b"", None]

    def states(d, data):
        h, n, out = np.zeros(model.hidden), model.hidden, []
        for byte in data:
            a, u = model.w[d + "x"][byte], h @ model.w[d + "h"]
            z, g = 1 / (1 + np.exp(-(a[:n] + u[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + u[n : 2 * n])))
            h = (1 - z) * h + z * np.tanh(a[2 * n :] + g * u[2 * n :])
            out.append(h)
        return out

    for text, got in zip(texts, model.reader().documents(texts), strict=True):
        total, text = np.zeros(3), (text or b"").lower()
        for at in range(0, len(text), language_id.STRIDE):
            first, last = max(0, at - language_id.MARGIN), min(len(text), at + language_id.STRIDE + language_id.MARGIN)
            part = text[first:last]
            h = np.concatenate([states("f", part), states("b", part[::-1])[::-1]], 1)
            p = np.exp(h @ model.w["out"] + model.w["bias"])
            total += (p / p.sum(1, keepdims=True))[at - first :][: language_id.STRIDE].sum(0)
        assert np.allclose(got, total / max(1, len(text)), atol=1e-4)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(30, "bench item")
    rows = [r[:5] for r in awkward()] + [(5000, f"{prose(50, 'q')} {item}", "en", "s", 1), (5001, prose(80, "clean"), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(collections.Counter(r.doc_id for r in docs.collect()))
    assert 5001 in kept[-1] and 5000 in kept[2] and 5000 not in kept[3]
    copies = [r[0] for r in rows if r[1] == rows[10][1]]
    assert [i for i in copies if i in kept[1]] == [min(copies)]
    assert all(n == 1 for n in kept[1].values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    passage = prose(60, "passage")
    assert sum(passage in (t or "") for t in texts.values()) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_near_duplicates_by_row(spark):
    """A repeated doc_id loses only the row that is a copy; rows of one id or of none are linked too."""
    import corpus_pipeline

    a, b, c, d = (prose(100, f"row {i}") for i in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (None, d), (None, d + " end"), (None, a), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, (r.text or "")[:100]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == collections.Counter((i, (t or "")[:100]) for i, t in [(1, a), (2, b), (3, c), (None, d), (4, None)])
