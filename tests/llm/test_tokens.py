"""SentencePiece with offsets and cross-tokenizer alignment against the libraries."""

import hashlib
import random
import struct
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
import tokenizers

from quillmart.llm import align, pieces

SF = "/root/testdata/sf0.001"
BITS = ["a", "Zü", " ", "  ", "\n", "'s", "12", "!?", "　", "日本", " é", "\0", "<s>", "<0x0A>", "<|endoftext|>", "😀", "�", "the ", "of", "tion", "\r\t", "------", "ﬁ", "Ａ", "ＡＢ"]


def texts(n, seed, more=()):
    r = random.Random(seed)
    return ["".join(r.choice([*BITS, *more]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def double_array(rules):
    """A compiled character map: each node's children lie at its base xor their byte, a rule's value at the base itself."""
    blob, value = b"", {}
    for text in rules.values():
        value[text] = len(blob)
        blob += text.encode() + b"\0"
    units, taken = {0: 0}, {0}
    todo = [(0, b"")]
    while todo:
        at, prefix = todo.pop()
        below = sorted({k.encode()[len(prefix)] for k in rules if k.encode().startswith(prefix) and len(k.encode()) > len(prefix)})
        ends = prefix.decode("utf-8", "replace") in rules and prefix != b""
        labels = [*([0] if ends else []), *below]
        base = next(b for b in range(1, 1 << 20) if all(b ^ c not in taken for c in labels) and (at ^ b) < 1 << 21)
        taken |= {base ^ c for c in labels}
        units[at] = units.get(at, 0) | (at ^ base) << 10 | (256 if ends else 0)
        if ends:
            units[base] = 1 << 31 | value[rules[prefix.decode()]]
        for c in below:
            units[base ^ c] = c
            todo.append((base ^ c, prefix + bytes([c])))
    size = (max(units) | 255) + 1
    data = struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])
    return struct.pack("<I", len(data)) + data + blob


def model_with(charsmap=b"", prefix=1, tidy=0):
    field = lambda n, v: bytes([n << 3 | 2]) + pieces._varint(len(v)) + v
    norm = field(1, b"own") + field(2, charsmap) + bytes([24, prefix, 32, tidy, 40, 1])
    with open(pieces.model_path(), "rb") as file:
        data = file.read()
    return b"".join(field(n, v) for n, v in pieces._fields(data) if n != 3) + field(3, norm)


@pytest.mark.parametrize("flags", [(1, 0), (0, 0), (1, 1), (0, 1)])
@pytest.mark.parametrize("rules", [{}, {"ﬁ": "fi", "Ａ": "a", "ＡＢ": "xyz  ", "　": " ", "\t": " ", "é": "", "日": " 日 "}])
def test_pieces_are_the_library(rules, flags):
    """Ids, byte spans and decoded texts for every kind of normaliser."""
    data = model_with(double_array(rules) if rules else b"", *flags)
    model, library = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    some = texts(300, 4, ["▁", " ▁ "])
    for text, (ids, low, high) in zip(some, model.encode(some), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert list(zip(low.tolist(), high.tolist(), strict=True))[1:-1] == [(p.begin, p.end) for p in want]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_decoding_of_any_ids():
    with open(pieces.model_path(), "rb") as file:
        model, library = pieces.Model(file.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(8)
    for _ in range(2000):
        ids = [r.choice([1, 2, 29871, 259, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_forgetting(monkeypatch):
    """Results do not depend on what is remembered."""
    monkeypatch.setattr(pieces, "WORDS", 3)
    with open(pieces.model_path(), "rb") as file:
        model, library = pieces.Model(file.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for text in [*texts(30, 5), "x" * 70_000, " " * 3000, "é" * 5000 + " a"]:
        assert model.encode([text])[0][0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_odd_rows_of_pieces(spark):
    kinds = "doc_id long, text string, ids string, row string"
    rows = [(1, None, "x", "y"), (2, "", "x", None), (2, "", "x", None), (None, " a  b ", "x", "y"), (5, "word " * 300_000, "x", "y"), (6, "é" * 200_000, "x", "y")]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.createDataFrame(rows, kinds).repartition(3)
    got = sorted(((r.row.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {(r.row.doc_id, r.decoded) for r in pieces.decode(pieces.encode(docs.limit(4))).select("row", "decoded").collect()}
    assert back <= {(1, ""), (2, ""), (None, " a  b "), (5, "word " * 300_000), (6, "é" * 200_000)}
    assert pieces.round_trip(docs.limit(0)).count() == 0


def plain_alignment(rows):
    """Every number of cross_tokens() by comparing all ends of both libraries' tokens."""
    a_side = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side, letters = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), align.byte_letters()
    docs, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        raw_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            docs.append((doc, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, raw[: i + 1])) for i in range(len(raw))] for raw in (raw_a, raw_b)]
        before, groups, links = 0, [], []
        for end in sorted(set(ends[0]) & set(ends[1])):
            own = [[i for i, e in zip(ids, at, strict=True) if before < e <= end] for ids, at in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(map(str, o)) for o in own))
            links.append((own[0][-1], own[1][-1]))
            before = end
        counts.update(links)
        docs.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, a, b, len(x), len(x), sum(counts[y] == best[y[1]] for y in x), sum(counts[y] for y in x), sha) for d, a, b, x, sha in docs), key=str)


@pytest.mark.parametrize("split", [50, 100_000])
def test_alignment_is_the_plain_one(spark, monkeypatch, split):
    monkeypatch.setattr(align, "SPLIT", split)
    rows = [*enumerate(texts(150, 6)), *enumerate(texts(30, 7, ["▁"])), (None, None), (7, None), (7, ""), (8, "a" * 400), (9, "x"), (9, "x")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, pairs string, row string")
    got = sorted(((r.row.doc_id, *r[1:]) for r in align.cross_tokens(docs).collect()), key=str)
    assert got == plain_alignment(rows)
    assert align.cross_tokens(docs.limit(0)).count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    got = sorted(((r.row.doc_id, *r[1:]) for r in align.cross_tokens(docs).collect()), key=str)
    assert got == plain_alignment([tuple(r) for r in docs.collect()])


def test_forgotten_windows():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(pieces.model_path(), "rb") as b:
        new = lambda: align.Aligner(align.ByteTokens(json_a, public_tokenizers.PATTERN), pieces.Model(model))
        json_a, model = a.read(), b.read()
    known, some = new(), [*texts(40, 9), "é" * 3000]
    known.rows(some)
    assert known.rows(some) == new().rows(some) and known.rows([]).to_pylist() == []
