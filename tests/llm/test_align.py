"""Alignment of two tokenizers against encoding whole texts, with and without chunks."""

import bisect
import collections
import hashlib
import itertools
import json
import random

import pytest
from tokenizers import Tokenizer
import sentencepiece

from habitloom.llm import align
from habitloom.llm.queries import QUERIES, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "  two  blanks ", "x▁y", "no break   here", "tab\tand\nlines\r\n\n end", "<|endoftext|> </s> <s>", "été λόγος 中文 日本語 🙂🙂 é",
       "don't they're 12345 !!! --- ...", "a\x00b \x1c c", "　wide 　 blank", "long" * 300]


def brute(rows):
    """The contract, each text encoded at once."""
    path = tokenizer_path("byte_bpe_50k.json")
    first = Tokenizer.from_file(path)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    with open(path, encoding="utf-8") as file:
        entry = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    to_byte = {}
    spare = itertools.count(256)
    for byte in range(256):
        to_byte[chr(byte) if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255 else chr(next(spare))] = byte
    found, counts = [], collections.Counter()
    for _, text in rows:
        row = (0, 0, "", [])
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_bytes = [bytes(to_byte[c] for c in entry[i]) for i in a]
            pieces = [second.id_to_piece(i) for i in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (list(itertools.accumulate(map(len, t))) for t in (a_bytes, b_bytes))
                groups, links, i, j = [], [], 0, 0
                for end in sorted(set(a_ends) & set(b_ends)):
                    k, m = bisect.bisect(a_ends, end), bisect.bisect(b_ends, end)
                    groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                    links.append((a[k - 1], b[m - 1]))
                    i, j = k, m
                row = (len(a), len(b), ";".join(groups), links)
        counts.update(row[3])
        found.append(row)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted((str(doc_id), n_a, n_b, len(links), len(links), sum(counts[link] == best[link[1]] for link in links), sum(counts[link] for link in links),
                   hashlib.sha256(text.encode()).hexdigest() if n_a else "") for (doc_id, _), (n_a, n_b, text, links) in zip(rows, found))


def rows_of(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


@pytest.mark.parametrize("chunk", [1 << 16, 64, 20])
def test_alignment_equals_whole_texts(spark, chunk):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    texts = ODD + [t for t in texts if t][:40] + [" ".join(rng.choice(["the", "señor", "λόγος", "x y", "don't", "a,b", "12345678"]) for _ in range(4000))]
    rows = [*enumerate(texts), (None, "no id"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS key", "1 AS pairs", "2 AS n_a")
    got = align.align(docs.repartition(3), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), chunk, 3)
    assert rows_of(got) == brute(rows)


def test_query_equals_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_fragment_monoid"](spark, SF_DIR)) == brute(rows)


def test_composition_is_associative():
    rng = random.Random(5)
    for _ in range(200):
        ends = [sorted(rng.sample(range(1, 40), rng.randint(1, 20))) for _ in range(2)]
        ids = [[rng.randrange(100) for _ in e] for e in ends]
        pieces = []
        cuts = [0, *sorted(rng.sample(range(1, 40), 4)), 40]
        for low, high in itertools.pairwise(cuts):
            own = [([i for i, e in zip(x, y) if low < e <= high], [e for e in y if low < e <= high]) for x, y in zip(ids, ends)]
            pieces.append(align.fragment_of(*own[0], *own[1])[0])
        whole = align.fragment_of(ids[0], ends[0], ids[1], ends[1])[0]
        a, b, c, d, e = pieces
        assert a.then(b).then(c).then(d).then(e) == a.then(b.then(c.then(d.then(e)))) == a.then(b.then(c)).then(d.then(e)) == whole
        assert whole.then(align.Fragment()) == whole == align.Fragment().then(whole)


def test_chunks_cover_the_text():
    raw = (" " + "word " * 40_000 + "x" * 200_000 + " end").encode()
    spans = list(align.chunks_of(raw, align.CHUNK))
    assert [s[2] for s in spans[1:]] == [s[3] for s in spans[:-1]] and spans[0][2] == 0 and spans[-1][3] == len(raw)
    assert len(spans) > 3 and all(start <= low < high <= end and raw[start:start + 1] == b" " for start, end, low, high in spans)
