"""Operators 12 and 13 against brute force."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import alignment, audit

SCHEMA = "doc_id long, text string, lang string, part string, mask string, pair string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghäé"), rng.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(130)
    texts = [None, "", " ", "x", base, base, base, base.upper(), base + " 5%", "same word " * 70, prose(60), prose(60) + "\n\tEND A|B", "ABC DEF ghi", "", None, prose(8000)]
    texts += ["two  spaces", " leads", "trails ", "<|endoftext|> and <s> </s>", "a▁b", "日本語 テキスト\n\n😀 x", "nul\x00byte", "é é ﬁ", "the the the cat " * 40, " odd space\r\nline"]
    langs = ["en", "de", None, ""]
    out = [(i, t, langs[i % 4], "x", "y", "z") for i, t in enumerate(texts)]
    return out + [out[4], out[5], (None, base, "en", "x", "y", "z"), (None, base, "de", "x", "y", "z"), (-3, "x", "de", "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


# 12 --------------------------------------------------------------------------------------------
LABELS = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (6, None, None), (7, 1, None), (9, 0, 0), (9, 1, 0), (11, None, 1), (None, 1, 1), (999, 1, 1)]


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    held = []
    for d, text, lang, *_ in rows:
        text = text or ""
        w = text.encode().split()
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and text in first and d > first[text],
        }
        held.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in held}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                r = Counter(kept=0, removed=0, redundant=0, unique_fails=0, good_lost=0, toxic_lost=0)
                for own, fails, g, t in held:
                    if own != part:
                        continue
                    before, now = any(fails[c] for c in order[: step - 1]), fails[order[step - 1]]
                    r["kept"] += not before and not now
                    r["removed"] += now and not before
                    r["redundant"] += now and before
                    r["unique_fails"] += now and sum(fails.values()) == 1
                    r["good_lost"] += now and not before and g
                    r["toxic_lost"] += now and not before and t
                total[order[step - 1]] += r["removed"]
                out[part, order, step] = r
        for (p, order, step), r in out.items():
            if p == part:
                r["shapley"] = total[order[step - 1]]
    return {k: dict(v) for k, v in out.items()}


def test_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in (x.asDict() for x in audit.audit_filters(docs, labels).collect())}
    want = brute_audit(rows, LABELS)
    assert got.keys() == want.keys() and len(got) == 3 * 600
    for key, r in want.items():
        assert {k: got[key][k] for k in r} == r, key


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.audit_filters(empty, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, "", "", "")], SCHEMA)
    assert audit.audit_filters(one, labels.limit(0)).where("removed = 1").select("step").count() == 120


def test_packed_counters_do_not_run_over():
    kinds = audit.packed_outcomes()
    n = (1 << 62) - 1
    total = n * kinds[31 * 4 + 3] + n * kinds[0]
    fields = audit.unpacked(total)
    assert fields.max() == n and (fields == n * (audit.outcomes(31, 1, 1).astype(object) + audit.outcomes(0, 0, 0).astype(object))).all()


# 13 --------------------------------------------------------------------------------------------
def brute_alignment(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    found, count = [], Counter()
    for d, text, *_ in rows:
        said = (" " + (text or "")).encode()
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        sa = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        sb = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        if not text or b"".join(sa) != said or b"".join(sb) != said:
            found.append((d, 0, 0, 0, [], ""))
            continue
        owner, spans_a, spans_b = {}, [], []
        at = 0
        for i, s in enumerate(sa):
            spans_a.append((at, at + len(s)))
            owner.update(dict.fromkeys(range(at, at + len(s)), i))
            at += len(s)
        at, pairs = 0, []
        for j, s in enumerate(sb):
            spans_b.append((at, at + len(s)))
            pairs += [(a[i], b[j]) for i in sorted({owner[x] for x in range(at, at + len(s))})]
            at += len(s)
        groups, ends_b, i, j = [], {e: k for k, (_, e) in enumerate(spans_b)}, 0, 0
        for k, (_, e) in enumerate(spans_a):
            if e in ends_b:
                m = ends_b[e]
                groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
                i, j = k + 1, m + 1
        count.update(set(pairs))
        found.append((d, len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(d, na, nb, ng, len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), h) for d, na, nb, ng, p, h in found]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held", [alignment.HELD, 50])
def test_alignment(docs, rows, held):
    got = sorted((tuple(r[c] for c in NAMES) for r in alignment.align(docs, held=held).collect()), key=repr)
    want = sorted(brute_alignment(rows), key=repr)
    assert got == want
    assert sum(x[1] > 0 for x in want) > 15 and any(x[1] == 0 and x[0] is not None for x in want)


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
    none = alignment.align(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_bitmaps_and_planes(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 60_000):
        low = np.sort(rng.choice(alignment.BLOCK, n, replace=False))
        assert (alignment.members(alignment.container(low)) == low).all() and len(alignment.container(low)) <= 8192
    # 5,000 documents hold one pair, document k holds it k % 7 + 1 times
    block = alignment.Block(9)
    block.docs = [(k, k, 0, 0, 0, 0, "") for k in range(5000)]
    times = np.arange(5000) % 7 + 1
    block.pairs, block.lows = [np.full(times.sum(), 77), np.full(3, 5)], [np.repeat(np.arange(5000), times), np.array([1, 1, 4])]
    rows = [r for b in list(block.rows())[1:] for r in b.to_pylist()]
    counts = alignment.pair_counts(spark.createDataFrame([(r["pair"], r["plane"], r["n"]) for r in rows], "pair long, plane int, n int"))
    assert {tuple(r) for r in counts.collect()} == {(77, 5000, int(times.sum())), (5, 2, 3)}
    assert {r["n"] for r in rows if r["pair"] == 77 and r["plane"] == 0} == {5000}
