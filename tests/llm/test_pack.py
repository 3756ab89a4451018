import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldlake.llm.pack import hilbert_key, pack

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def check(df, rows, length=2048):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    got = pack(df, JSON, length=length).collect()
    want = sorted((i if i is not None else -1, bytes(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))) for i, t in rows)
    stream, sizes = {}, {}
    for r in got:
        assert 0 < r.length <= length and r.offset + r.length <= length
        stream[r.sequence_id * length + r.offset] = r
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length for s, n in sizes.items() if s != len(sizes) - 1)
    at, docs, open_ = 0, [], b""
    for place in sorted(stream):  # gapless, and a document's pieces follow one another
        r = stream[place]
        assert place == at and r.start * 4 == len(open_)
        at, open_ = at + r.length, open_ + bytes(r.token_bytes)
        if len(open_) == 4 * r.doc_tokens:
            docs.append((r.doc_id if r.doc_id is not None else -1, open_))
            open_ = b""
    assert open_ == b"" and sorted(docs) == want
    assert all(zlib.crc32(bytes(r.token_bytes)) >= 0 for r in got)


def test_pieces_hold_every_id_once(spark):
    rows = [(i, f"word{i % 7} " * (i * 13 % 900)) for i in range(120)] + [(5, "same"), (5, "same"), (None, "no id"), (9, None), (10, ""), (11, "x" * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, length int")
    check(df, rows)
    check(df, rows, length=64)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), JSON).collect() == []
