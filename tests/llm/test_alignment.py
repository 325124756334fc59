"""Alignment of two tokenizers against a direct count over all tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest

from roomledger.llm import alignment

SF = "/root/testdata/sf0.001"


def spelt(tool, raw, ids, names):
    parts = [names[i] for i in ids]
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
    return ends if b"".join(parts) == raw else None


def brute(rows):
    tool = alignment.Aligner(alignment.vocabulary_path(alignment.VOCABULARY_A), alignment.vocabulary_path(alignment.VOCABULARY_B))
    docs = []
    for _, text in rows:
        if not text:
            docs.append(None)
            continue
        raw = (" " + text).encode()
        a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
        ends_a, ends_b = spelt(tool, raw, a, tool.bytes_a), spelt(tool, raw, b, tool.bytes_b)
        if ends_a is None or ends_b is None:
            docs.append(None)
            continue
        owner_a, owner_b = [], []
        for owner, ids, ends in ((owner_a, a, ends_a), (owner_b, b, ends_b)):
            for k, _ in enumerate(ids):
                owner += [k] * (ends[k] - len(owner))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b, strict=True)))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        docs.append((len(a), len(b), links, groups))
    count = Counter(p for d in docs if d for p in set(d[2]))
    best = defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    out = []
    for (doc_id, _), d in zip(rows, docs, strict=True):
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = d
            sums = sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)
            out.append((doc_id, n_a, n_b, len(groups), len(links), *sums, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (1, " lead"), (2, "trail "), (3, "two  spaces\n\nand\ta tab"), (4, "a ▁x"), (5, None), (6, ""), (None, "a b é́ 日本"), (None, "again"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "same row"), (8, "same row"), (9, "x" * 300 + " " + "ab\ncd " * 50 + "end"),
    (10, "\x00\x1c"), (11, "​ zero"), (12, "日本語" * 200), (13, "don't can't we'll\nit's 12345 67.8"), (14, " "), (15, "\n"), (16, " "),
]


@pytest.fixture
def frame(spark):
    rows = [*ODD, *((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect())]
    return rows, spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, n_a string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"size": 64, "fan": 2}, {"size": 7, "fan": 3}])
def test_aligned_documents(frame, options):
    rows, df = frame
    assert sorted(map(tuple, alignment.aligned_documents(df, **options).collect()), key=repr) == brute(rows)


def test_more_pairs_than_one_table_holds(frame, monkeypatch):
    rows, df = frame
    monkeypatch.setattr(alignment, "PAIRS", 400)
    assert sorted(map(tuple, alignment.aligned_documents(df, size=200).collect()), key=repr) == brute(rows)


def test_no_documents(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.aligned_documents(only).collect())) == [(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2)]


def test_a_segment_is_encoded_as_in_its_text(spark):
    tool = alignment.Aligner(alignment.vocabulary_path(alignment.VOCABULARY_A), alignment.vocabulary_path(alignment.VOCABULARY_B))
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    for text in texts[:400]:
        parts = alignment.Parts.of(tool, [text], with_groups=True)
        whole = alignment.groups_of(tool.whole(text))
        assert ";".join(parts.texts[p] for p in parts.parts) == whole.text
        assert parts.sizes[parts.parts].sum(0).tolist() == [whole.n_a, whole.n_b, whole.n_groups]


def test_composition_is_associative(spark):
    tool = alignment.Aligner(alignment.vocabulary_path(alignment.VOCABULARY_A), alignment.vocabulary_path(alignment.VOCABULARY_B))
    tokens = tool.whole("Internationalisation 日本 of\n\nthe extraordinarily uncommon wordings, é and so on.")
    parts = [alignment.fragment(alignment._between(tokens, k, k + 3))[0] for k in range(0, int(tokens[1][-1]), 3)]
    plain = lambda f: (f.cut, [x.tolist() for x in (*f.prefix, *f.suffix)])
    for x, y, z in zip(parts, parts[1:], parts[2:], strict=False):
        assert plain(x.then(y)[0].then(z)[0]) == plain(x.then(y.then(z)[0])[0])
