"""The training-data operators against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.llm import embeddings, licenses, lines, minhash, mixing, packing, quality, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, line string"


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "the" if rng.random() < 0.15 else "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    prose = lambda n: " ".join(word() + (".\n" if rng.random() < 0.08 else "") for _ in range(n)).replace("\n ", "\n")
    base = [prose(120) for _ in range(6)]
    texts = [None, "", " \n\t ", "x", "x", "ABC def ghi", *base, base[0], base[0], prose(20_000)]
    for k in range(6):
        words = base[1].split(" ")
        words[10 * k + 3] = "changed"
        texts.append(" ".join(words))
    texts += [prose(40) + "\n" + base[2][:330] + "\n" + prose(30) for _ in range(3)]
    texts += [base[3][:100] + "Z" + base[3][100:], base[3].replace("a", "ä", 3), "same words " * 60, base[4].upper()]
    return [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "mine", "mine", "mine") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# 4 ---------------------------------------------------------------------------------------------
def test_quality_signals(docs, rows, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        w = words(text)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(three)
        covered = {k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)}
        held = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text or ""), len(held) - len(set(held)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(empty).count() == 0
    assert set(quality.keep_good(docs).columns) == set(docs.columns)


def test_repeated_words_are_exact_under_hash_ties(spark, docs):
    rng = np.random.default_rng(5)
    long = ["w%d" % x for x in rng.integers(0, 10**9, 200_000)]
    long[150_000:150_003] = long[10:13]
    texts = [" ".join(long), " ".join("ab"[x] for x in rng.integers(0, 2, 40)), " ".join("w%d" % x for x in range(500)), "a b c x a b c", "a b a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for bits in (64, 6, 1):
        got = {r.doc_id: r.n_repeat_words for r in quality.signals(df.where("doc_id > 0") if bits < 64 else df, hash_bits=bits).collect()}
        for i, n in got.items():
            w = texts[i].split()
            three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            count = Counter(three)
            assert n == len({k + j for k, x in enumerate(three) if count[x] > 1 for j in range(3)}), (bits, i)


# 2 ---------------------------------------------------------------------------------------------
def test_licenses(spark, empty):
    mit = licenses.LICENSES["MIT"]
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;"), mit + " more", "one\nAll rights reserved.\ntwo", None, "", mit.replace("sublicense", "sub-licence")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan_licenses(df).collect()}
    assert got[0][0] == "MIT" and got[1][0] is None and got[2] == (None, ["Reserved (notice)"]) and got[3] == got[4] == (None, [])
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("license_id, title", [("MIT", "MIT License"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("Zlib", "zlib License")])
def test_license_files_with_their_title(spark, license_id, title):
    text = f"{title}\n\nCopyright (c) 2021 A. Person\n\n{licenses.LICENSES[license_id]}\n"
    df = spark.createDataFrame([(0, text), (1, "Another Title\n" + text)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan_licenses(df).collect()} == {0: license_id, 1: None}


def test_known_texts_that_fold_to_one(spark):
    known = {"B": "One line.\nTwo lines!", "A": "one LINE\n\ntwo, lines", "Y": "Free for all.", "X": "free for: ALL"}
    df = spark.createDataFrame([(0, "One line\ntwo lines"), (1, "x\nfree for all\nfree for all"), (1, "x\nfree for all\nfree for all"), (2, "word " * 200_000 + "\nFree for all")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan_licenses(df, licenses=known).collect())
    assert licenses.scan_licenses(df, licenses={"B": known["B"]}).where("doc_id = 0").first().license_id == "B"
    assert got == [(0, "A", []), (1, None, ["X"]), (1, None, ["X"]), (2, None, ["X"])]


# 3 ---------------------------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(1, 4))
def test_banded_distance(a, b, most):
    assert lines.within(a, b, most) == (distance(a, b) <= most)


def allowed(a, b):
    return min(lines.EDITS, min(len(a), len(b)) // lines.PER_EDIT)


def linked_lines(held):
    """Brute force: which pairs of distinct lines are linked."""
    for i, a in enumerate(held):
        for b in held[:i]:
            if abs(len(a) - len(b)) <= lines.EDITS and distance(a, b) <= allowed(a, b):
                yield a, b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=2, max_size=12, unique=True), st.integers(1, 3), st.integers(1, 6))
def test_many_distances_at_once(texts, edits, per_edit):
    held = lines.Lines(texts, edits, per_edit)
    pairs = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and 0 <= len(b) - len(a) <= edits]
    if pairs:
        i, j = (np.array(x) for x in zip(*pairs))
        bound = [min(edits, len(texts[k]) // per_edit) for k in i]
        assert held.linked(i, j).tolist() == [distance(texts[x], texts[y]) <= m for x, y, m in zip(i, j, bound)]


def edited(rng, x, n):
    x = list(x)
    for _ in range(n):
        k = int(rng.integers(0, len(x)))
        if rng.random() < 0.5:
            x[k] = rng.choice(list("abcd"))
        else:
            x.pop(k) if rng.random() < 0.5 else x.insert(k, "a")
    return "".join(x)


@pytest.mark.parametrize("large", [lines.LARGE, 3])
def test_line_dedup(spark, empty, large, monkeypatch):
    monkeypatch.setattr(lines, "LARGE", large)
    monkeypatch.setattr(lines, "BLOCK", large)
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcd "), n)) for n in (8, 11, 12, 15, 20, 23, 24, 25, 40, 40, 41, 90)]
    every = [x for b in base for x in (b, *(edited(rng, b, rng.integers(0, 4)) for _ in range(5)))]
    texts = ["\n".join(every[k : k + 6]) for k in range(0, len(every), 6)] + [None, "", "short\nshort\n", every[0] + "\n" + every[0], "word " * 30_000 + "\nx", "word " * 30_000 + "y\nx"]
    df = spark.createDataFrame([(i, t, "c", "k") for i, t in enumerate(texts)], "doc_id long, text string, line_no string, key string")
    got = {(r.doc_id, r.line_no): (r.n_links, r.class_doc_id, r.class_line_no, r.kept) for r in lines.dedup_lines(df).collect()}
    place, first = {}, {}
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if x.encode().split():
                place[i, k] = x
                first.setdefault(x, (i, k))
    parent, degree = {v: v for v in first.values()}, Counter()
    n = len(texts)
    links = [*linked_lines([x for x in first if len(x) < 1000]), (texts[n - 2].split("\n")[0], texts[n - 1].split("\n")[0])]
    for a, b in links:
        degree[first[a]] += 1
        degree[first[b]] += 1
        x, y = find(parent, first[a]), find(parent, first[b])
        parent[max(x, y)] = min(x, y)
    assert sum(degree.values()) > 20 and any(len(a) < 24 for a, _ in links)
    assert got == {k: (degree[first[x]], *find(parent, first[x]), k == find(parent, first[x])) for k, x in place.items()}
    assert lines.dedup_lines(empty).count() == 0
    left = {r.doc_id: r.text for r in lines.without_repeats(df).collect()}
    assert left[n - 4] == "short\n" and n - 3 not in left and n - 1 not in left and left[n - 6] is None
    again = lines.dedup_lines(df.unionByName(df)).groupBy("doc_id", "line_no").count().collect()
    assert len(again) == len(got) and all(r["count"] == 2 for r in again)


def test_a_hot_group_of_near_lines(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 60))
    held = sorted({edited(rng, base, 1) for _ in range(1500)} | {edited(rng, base, 2) for _ in range(600)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(held)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    degree = Counter()
    for i, a in enumerate(held):
        for j in range(i):
            if lines.within(a, held[j], 2):
                degree[i] += 1
                degree[j] += 1
    assert len(held) > 700 and {i: r.n_links for i, r in got.items()} == {i: degree[i] for i in range(len(held))}
    assert {r.class_doc_id for r in got.values()} == {0}
    distinct = df.select(F.struct("doc_id", F.lit(0).alias("line_no"), F.xxhash64("text").alias("h")).alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("line"))
    assert lines.linked_lines(distinct, 2, 12).count() < 20 * len(held)


# 5 ---------------------------------------------------------------------------------------------
def test_toxicity_learns_pairs(spark, empty):
    rng = np.random.default_rng(2)
    filler = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = []
    for i in range(1500):
        insult, group = rng.random(2) < 0.5
        own = [*rng.choice(filler, 20), *(["numbskull"] if insult else []), *(["gardeners"] if group else [])]
        rows.append((i, " ".join(rng.permutation(own)), int(insult and group)))
    rows += [(1500, None, None), (1501, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(2)
    got = {r.doc_id: r for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[2] is not None]
    assert all(got[r[0]].held_out for r in held) and not got[next(r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5)].held_out
    right = np.mean([got[r[0]].predicted == r[2] for r in held])
    assert right >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(empty, df.select("doc_id", "toxic")).count() == 0


def test_toxicity_learns_a_pair_of_which_neither_word_tells(spark):
    rng = np.random.default_rng(6)
    filler = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(4000)]
    rows = []
    for i in range(4000):
        one, other = rng.random(2) < 0.5
        own = [*rng.choice(filler, 20), *(["numbskull"] if one else []), *(["gardeners"] if other else [])]
        rows.append((i, " ".join(rng.permutation(own)), int(one != other)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(2)
    got = {r.doc_id: r for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) >= 0.95


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(9)
    weights, vectors = rng.normal(size=12), rng.normal(size=(12, 3))
    sets = [[], [4], [0, 3, 7], list(range(12))]
    got, _ = toxicity.margin(toxicity.Rows(sets), 0.7, weights, vectors)
    want = [0.7 + sum(weights[i] for i in x) + sum(vectors[i] @ vectors[j] for k, i in enumerate(x) for j in x[:k]) for x in sets]
    assert np.allclose(got, want)


def test_factors_tell_what_weights_cannot():
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([rng.integers(2, 200, 8), np.flatnonzero(rng.random(2) < 0.5)])) for _ in range(3000)]
    labels = np.array([float((0 in x) != (1 in x)) for x in sets])
    model = toxicity.fit(sets[:2400], labels[:2400])
    places = {int(t): i for i, t in enumerate(model["terms"])}
    rows = toxicity.Rows([[places[int(t)] for t in x if int(t) in places] for x in sets[2400:]])
    right = lambda vectors: np.mean((toxicity.margin(rows, float(model["bias"]), model["weights"], vectors)[0] > 0) == labels[2400:])
    assert right(model["vectors"]) >= 0.95 and right(0 * model["vectors"]) <= 0.85


# 6 ---------------------------------------------------------------------------------------------
def repeats_by_force(raw, length):
    n, out = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1)), {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "width", "chunk", "hot", "shard", "batches"), [(200, 32, 1 << 20, 4096, 1 << 18, 4), (30, 8, 64, 4096, 2000, 5), (200, 32, 500, 3, 5000, 3)])
def test_repeats(docs, rows, empty, length, width, chunk, hot, shard, batches, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", shard)
    small = docs if length == 200 else docs.where("doc_id < 14")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(small, length, width, batches=batches).collect()}
    assert got == repeats_by_force({i: (t or "").encode() for i, t, *_ in rows if i in got}, length)
    assert repeats.remove_repeats(empty).count() == 0


def test_a_passage_between_different_neighbours(spark, monkeypatch):
    """A hot key: what goes on grows with distinct bytes near the passage, not with windows of all copies."""
    monkeypatch.setattr(repeats, "HOT", 12)
    rng = np.random.default_rng(2)
    some = lambda n, letters: "".join(rng.choice(list(letters), n))
    passage, raw = some(400, "abcdefghij"), {}
    for i in range(90):
        raw[i] = some(150, "xy" if i % 3 else "abcdefghij") + (passage if i % 5 else passage[:230]) + some(150, "xyz")
    raw |= {100: raw[1], 101: raw[1][20:], 102: passage, 103: ""}
    held, cut = {}, repeats.cut
    monkeypatch.setattr(repeats, "cut", lambda df, tag: (out := cut(df, tag), held.setdefault(tag, []).append(out.count()))[0])
    df = spark.createDataFrame(list(raw.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert got == repeats_by_force({i: t.encode() for i, t in raw.items()}, 200)
    windows = sum(max(0, len(t) - 199) for t in raw.values())
    assert len(held["ranges"]) == 3 and held["ranges"][2] < windows / 10 and held["pieces"][0] < windows / 10


def test_repeated_rows_are_copies_of_each_other(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdef\0é"), 700))
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:150]), (3, None), (3, text[300:520] + "x" * 50)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect())
    n = len(text.encode())
    assert got[:2] == [(1, n, n), (1, n, n)] and got[2][2] == 0 and got[3] == (3, 0, 0) and got[4][2] == len(text[300:520].encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=12).map(lambda x: bytes(b"\0ab"[y % 3] for y in x)), min_size=1, max_size=4), min_size=2, max_size=4))
def test_suffix_arrays_scan_and_merge(parts):
    held, texts = [], []
    for i, p in enumerate(parts):
        texts.append(p)
        held.append(repeats.Suffixes.of(np.full(len(p), i), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), p, 4))
    windows = lambda p: [x[k : k + 4] for x in p for k in range(len(x) - 3)]
    raw = lambda s: [s.text[o : o + 4] for o in s.order]
    for s, p in zip(held, texts):
        assert raw(s) == sorted(windows(p)) and s.twice().tolist() == [raw(s).count(x) > 1 for x in raw(s)]
    a, b = held[:2]
    here, there = a.scan(b)
    assert here.tolist() == [x in raw(b) for x in raw(a)] and there.tolist() == [x in raw(a) for x in raw(b)]
    both = a.merged(b)
    assert raw(both) == sorted(windows(texts[0]) + windows(texts[1]))
    assert sum(both.runs(np.ones(len(both.order), bool))[3]) == len(both.order)


# 1 and 7 ---------------------------------------------------------------------------------------
MARK = "<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("ab '\n\té1.,x s"), max_size=12), st.text(max_size=6), st.sampled_from([MARK, " " + MARK, MARK[:-1], "<|"])), max_size=6).map("".join))
def test_ids_are_those_of_the_public_tokenizer(text):
    assert np.frombuffer(packing.encoder(None)(text), "<u4").tolist() == public().encode(text, add_special_tokens=False).ids


_public = []


def public():
    if not _public:
        import public_tokenizers
        from tokenizers import Tokenizer

        _public.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return _public[0]


def ids_of(text):
    return [*public().encode(text or "", add_special_tokens=False).ids, 1]


def test_windows(docs, rows, empty):
    got = packing.pack_documents(docs).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in rows:
        ids, at = ids_of(text), 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // packing.WINDOW) + 2
    assert packing.pack_documents(empty).count() == 0


def test_matrices(docs, rows, empty):
    found = defaultdict(dict)
    for r in packing.token_matrices(docs).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == packing.WINDOW and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found[doc][start] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for i, text, *_ in rows:
        assert [x for _, p in sorted(found[i].items()) for x in p] == ids_of(text)
    assert packing.token_matrices(empty).count() == 0


def test_written_matrices_are_read_back(spark, docs, rows, tmp_path):
    df = spark.createDataFrame([(1, f"a {MARK} b"), (2, "x" * 9000), (3, None)], "doc_id long, text string")
    packing.write_matrices(packing.token_matrices(df, window=64), str(tmp_path / "m"))
    with pytest.raises(Exception, match="exist"):
        packing.write_matrices(packing.token_matrices(df, window=64), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).orderBy("sequence_id").collect()
    matrix = np.stack([np.frombuffer(r.ids, "<u2") for r in back])
    assert matrix.shape == (len(back), 64)
    pieces = {(d, s): matrix[i, a:b].tolist() for i, r in enumerate(back) for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:])}
    for i, t in ((1, f"a {MARK} b"), (2, "x" * 9000), (3, None)):
        assert [x for (d, _), p in sorted(pieces.items()) if d == i for x in p] == ids_of(t)


def test_ids_that_do_not_fit_are_refused(spark, docs):
    assert packing.narrow(np.array([65535], "<u4").tobytes(), 2) == b"\xff\xff"
    with pytest.raises(ValueError, match="65536"):
        packing.narrow(np.array([1, 65536], "<u4").tobytes(), 2)
    with pytest.raises(ValueError, match="2 bytes"):
        packing.token_matrices(docs, end=70_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=14))
def test_packers(sizes):
    for pack in (packing.best_fit_decreasing, packing.minimum_bin_slack):
        placed = pack(sizes, 20)
        used = defaultdict(list)
        for (bin_id, offset), n in zip(placed, sizes):
            used[bin_id].append((offset, n))
        for own in used.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 20
    best = max((s for m in range(1 << min(len(sizes), 10)) if (s := sum(x for k, x in enumerate(sizes[:10]) if m >> k & 1)) <= 20), default=0)
    assert sum(k * v for k, v in packing.fullest_subset(Counter(sizes[:10]), 20).items()) == best


# 8 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [2000, 7])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LARGE", 2 * block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 20))
    vectors = [base[i % 12] + rng.normal(size=20) * (0.02 * (i % 7)) for i in range(200)] + [base[0]] * 5 + [np.zeros(20)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i % 17 else None, "x", "y") for i, v in enumerate(vectors)]
    rows += [(900, None, 1, "x", "y"), (901, [], 1, "x", "y"), (902, [1.0, None], 1, "x", "y"), (903, [float("nan")] * 20, 1, "x", "y"), (904, [float("inf")] * 20, 1, "x", "y")]
    rows += [(905, [1.0, 2.0], 1, "x", "y"), (906, [2.0, 4.0], 1, "x", "y"), (907, [0.0, 1.0], 1, "x", "y"), (908, [-0.0, 1.0], 1, "x", "y"), (909, [1e-30, 2e-30], 1, "x", "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string, h string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    parent, degree = {r[0]: r[0] for r in rows}, Counter()
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label, *_ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {(i, j) for k, (i, v, a) in enumerate(good) for j, w, b in good[:k] if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        x, y = find(parent, i), find(parent, j)
        parent[max(x, y)] = min(x, y)
    assert len(links) > 250
    assert got == {k: (degree[k], find(parent, k), find(parent, k) == k) for k in parent}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    twice = embeddings.near_duplicates(df.unionByName(df)).groupBy("vec_id").agg(F.max("n_links").alias("n"), F.count("*").alias("c")).collect()
    assert all(r.c == 2 and r.n == (2 * degree[r.vec_id] + 1 if any(r.vec_id == g[0] for g in good) else 0) for r in twice)


@pytest.mark.parametrize(("dim", "n_hashes"), [(64, 2), (300, 1)])
def test_tables_find_pairs_just_at_the_threshold(dim, n_hashes):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(2, 2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    n_tables, _ = embeddings.plan(50_000, dim, 0.98, 5)
    a, b = (embeddings.buckets(v, n_tables, n_hashes, 5) for v in (x, y))
    assert (a[..., :, None] == b[..., None, :]).any((1, 2, 3)).mean() >= 0.998
    apart = np.bitwise_count(embeddings.bits(x, 5) ^ embeddings.bits(y, 5)).sum(1, dtype=int)
    assert apart.max() <= embeddings.bits_apart(0.98)


# 9 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("rounds", "block"), [(2, 500), (0, 500), (0, 4)])
def test_minhash(spark, rounds, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = [None, "", " \n ", "one two", "One TWO", "one two three"]
    for _ in range(4):
        base = list(rng.choice(vocabulary, 90))
        for k in range(12):
            x = list(base)
            for _ in range(k % 5):
                x[int(rng.integers(0, 90))] = str(rng.choice(vocabulary))
            texts.append(" ".join(x))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sketch string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4, 80, rounds=rounds).collect()}
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    parent = {i: i for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(sets[i]), find(parent, i), find(parent, i) == i) for i in parent}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------------------------
def test_mixing(spark, empty):
    rows = [(i, " ".join(["w"] * (i % 9)), "big" if i % 2 else f"s{i % 6}" if i % 10 else None, "x") for i in range(600)] + [(1000, None, "dry", "x"), (1001, "", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    for limit, budget in ((1.5, None), (3.0, 5000), (1.0, 700)):
        out = mixing.mix_sources(df, budget_tokens=budget, max_repeats=limit, block_tokens=50).collect()
        tokens = {r[0]: len((r[1] or "").split()) for r in rows}
        of = {r[0]: r[2] for r in rows}
        total, share, used, uses = sum(tokens.values()), Counter(), Counter(), Counter()
        for k, n in tokens.items():
            share[of[k]] += n
        for r in out:
            assert r.n_tokens == tokens[r.doc_id] and r.source == of[r.doc_id]
            used[r.source] += r.n_tokens
            uses[r.doc_id, r.epoch] += 1
        assert all(n == 1 for n in uses.values())
        weight = {r.source: r.weight for r in out}
        assert abs(sum(weight.values()) - 1) < 1e-9
        for s, w in weight.items():
            quota = w * (budget or total)
            assert quota - 9 <= used[s] <= quota + 1e-6
            assert budget is not None or quota <= limit * share[s] + 1e-6
        # a document is used at most once more than another of its source
        times = defaultdict(set)
        n_times = Counter(r.doc_id for r in out)
        for k, s in of.items():
            if s in weight:
                times[s].add(n_times[k])
        assert all(max(x) - min(x) <= 1 for x in times.values())
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_meets_entropy(spark):
    df = spark.createDataFrame([(i, "a b c d", "big" if i < 800 else f"s{i % 4}") for i in range(1000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(df, target_entropy=1.3, max_repeats=None)
    weights = [r[0] for r in out.select("weight", "source").distinct().collect()]
    assert abs(-sum(w * np.log(w) for w in weights) - 1.3) < 1e-3


# pipeline --------------------------------------------------------------------------------------
def line_classes(texts):
    """(doc, line) -> first place of its class, for lines with a word."""
    place, first = {}, {}
    for i, t in sorted(texts.items()):
        for k, x in enumerate(t.split("\n")):
            if x.encode().split():
                place[i, k] = x
                first.setdefault(x, (i, k))
    parent, held = {v: v for v in first.values()}, list(first)
    for i, a in enumerate(held):
        for b in held[:i]:
            if abs(len(a) - len(b)) <= 2 and lines.within(a, b, allowed(a, b)):
                x, y = find(parent, first[a]), find(parent, first[b])
                parent[max(x, y)] = min(x, y)
    return {k: find(parent, first[x]) for k, x in place.items()}


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as P

    docs.select(P.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    now, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or now.columns == P.DOCUMENTS
        stages.append(now.collect())
    judged = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    texts = {i: t for i, t, *_ in rows if i in judged}
    assert {r.doc_id: r.text for r in stages[0]} == texts and len(texts) > 8
    classes, left = line_classes(texts), {}
    for i, t in texts.items():
        own = [x for k, x in enumerate(t.split("\n")) if (i, k) not in classes or classes[i, k] == (i, k)]
        if any(x.encode().split() for x in own):
            left[i] = "\n".join(own)
    assert {r.doc_id: r.text for r in stages[1]} == left and left != texts
    sets = {}
    for i, t in left.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    alone = {i for i in left if find(parent, i) == i}
    assert {r.doc_id for r in stages[2]} == alone
    used = Counter(r.doc_id for r in stages[3])
    assert set(used) <= alone and len(stages[3]) > 3 and all(r.text == left[r.doc_id] for r in stages[3])
    packed = Counter()
    for r in stages[4]:
        packed[r.doc_id] += r.length
    assert packed == {i: n * len(ids_of(left[i])) for i, n in used.items()}


def test_pipeline_over_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as P

    empty.select(P.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
