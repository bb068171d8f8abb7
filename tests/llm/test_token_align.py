"""The alignment of tokens against one of whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries, token_align
from tessera.llm.common import Scratch

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  \n  a  b \n"), (6, "x▁y z"), (7, "<|endoftext|> <s> </s> <unk>"), (8, "don't, we'll\tgo\r\nnow\x0b\x1c!\x1c b"),
    (9, "слово и ещё слово あいう えお　全角 空白"), (10, "\U0001f600 \U0001f468‍\U0001f469 é é\x85 x\xa0 y  z"), (11, "\x00 a\x00b \x7f"), (12, "no_spaces" * 400), (12, "the the the"), (None, "the end"),
    (13, "a b\n" * 3000), (14, "深度学习" * 1500 + " ende"), (15, "é   　 ü\n" * 700), (16, "the the the"),
]


@pytest.fixture(scope="module")
def both():
    return token_align.Tokenizers(A, B)


def whole(text, both):
    """(a ids, b ids, groups, links) of a text taken whole, or None without tokens."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    spans = []
    for ids, known in ((a, both.a_bytes), (b, both.b_bytes)):
        if b"".join(known[i] for i in ids) != (" " + text).encode():
            return None
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(known[i]), i))
            at += len(known[i])
        spans.append(own)
    common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, start = [], 0
    for end in common:
        groups.append("|".join(",".join(str(i) for s, e, i in own if start < e <= end) for own in spans) if len(text) < 500 else (start, end))
        start = end
    links, j = [], 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    if len(text) >= 500:  # the same in one pass
        groups, at = [], [0, 0]
        for _, end in groups_of(common):
            part = []
            for w, own in enumerate(spans):
                first = at[w]
                while at[w] < len(own) and own[at[w]][1] <= end:
                    at[w] += 1
                part.append(",".join(str(i) for _, _, i in own[first : at[w]]))
            groups.append("|".join(part))
    return a, b, groups, links


def groups_of(common):
    return list(zip([0, *common], common))


def plain(rows, both):
    done = [(d, whole(t, both)) for d, t in rows]
    count = Counter(x for _, w in done if w for x in w[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d, w in done:
        if w is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = w
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((d, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def test_op12_equals_whole_texts(spark, both):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    assert found(queries.op12_alignment(spark, "/root/testdata/sf0.01")) == plain(rows, both)


@pytest.mark.parametrize("ranges", [{}, {"long_chars": 5, "range_bytes": 7, "fan": 2}, {"long_chars": 100, "range_bytes": 64, "broadcast_pairs": 0}, {"table_limit": 10, "broadcast_pairs": 0}])
def test_odd_texts_whole_and_by_ranges(spark, both, ranges):
    rows = [(d, t if t is None or "range_bytes" not in ranges or ranges["range_bytes"] > 7 else t[:600]) for d, t in ODD]
    docs = spark.createDataFrame([(d, t, 1, "g", "r") for d, t in rows], "doc_id long, text string, n_a int, codes string, row string")
    with Scratch(spark) as work:
        done = token_align.align(docs, A, B, work, **ranges)
        assert set(done.columns) == {*COLS, "codes", "row"} and found(done) == plain(rows, both)


def test_no_documents(spark):
    with Scratch(spark) as work:
        assert token_align.align(spark.createDataFrame([], "doc_id long, text string"), A, B, work).collect() == []


def test_composition_is_associative(both):
    table, rng = token_align.ChunkTable(both), random.Random(3)
    letters = ["a", "the", " ", " ", "\n", "é", " ", "全", "\t", "'s", "\U0001f600", "▁" * 0, "\x1c", "1"]
    same = lambda x: (x[0], x[1] and (x[1].figures.tolist(), x[1].groups, x[1].codes.tolist(), x[1].times.tolist()), x[2])
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        data = b" " + text.encode()
        at = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(3))})
        parts = [token_align.fragment(data[i:j], table) for i, j in zip(at, at[1:])]
        left, right = parts[0], parts[-1]
        for x in parts[1:]:
            left = token_align.compose(left, x, table)
        for x in parts[-2::-1]:
            right = token_align.compose(x, right, table)
        ends = [token_align.finished(x, table) for x in (left, right)]
        assert same((b"", ends[0], b"")) == same((b"", ends[1], b"")) == same((b"", table.closed([data.decode()])[0], b""))
        want = whole(text, both)
        assert ends[0].groups == ";".join(want[2]) and ends[0].figures.tolist() == [len(x) for x in want]


def test_cuts_do_not_touch_tokens_of_random_texts(both):
    table, rng = token_align.ChunkTable(both, 50), random.Random(8)
    for _ in range(1500):
        text = "".join(chr(rng.choice([32, 32, 10, 9, 13, 28, 97, 98, 39, 115, 49, 0x85, 0xA0, 0x2003, 0x3000, 0xE9, 0x301, 0x4E00, 0x1F600, rng.randrange(1, 0xD7FF)])) for _ in range(rng.randrange(1, 25)))
        want, got = whole(text, both), table.closed([" " + text])[0]
        assert (want is None) == (not got.ok)
        if want:
            assert got.groups == ";".join(want[2]), text
