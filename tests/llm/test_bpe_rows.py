"""What DuckDB is handed at once by the byte-level BPE stays small, whatever the number of pieces."""

import random

import numpy as np
import public_tokenizers

from lexitag.llm import bpe
from lexitag.llm.queries import VOCABULARY


def test_rows_at_once(monkeypatch):
    coder = bpe._Coder(bpe.read_ranks(public_tokenizers.path(VOCABULARY)))
    contracted, decoded = [], []
    contract, decode = coder._contract, coder.decode
    monkeypatch.setattr(coder, "_contract", lambda p: contracted.append(sum(len(x) * (len(x) + 1) // 2 for x in p)) or contract(p))
    monkeypatch.setattr(coder, "decode", lambda ids, ends: decoded.append(len(ids)) or decode(ids, ends))
    rng = random.Random(3)
    pieces = list({" " + "".join(rng.choices("abcdefghijklmno", k=12)) for _ in range(9000)})
    coded = coder.encode_pieces(pieces)
    assert coded == [coder._contract_long(p.encode()) for p in pieces]
    assert len(contracted) > 2 and max(contracted) <= 300_000
    texts = [np.frombuffer(c, "<u4") for c in coded] * 10
    ends = np.cumsum([len(t) for t in texts])
    assert bpe._decode_in_parts(coder, np.concatenate(texts), ends) == [p.encode() for p in pieces] * 10
    assert len(decoded) > 1 and max(decoded) <= 400_000
