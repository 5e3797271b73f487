import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from kithara.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "It's  he'LL\x0bx\x0cy\x1cz", "a b c\u0085d", "J̌ é ́x", "<|endoftext|>mid<|startoftext|>", "<|ENDOFTEXT|>", "\x00nul\x00", "İstanbul ǅ ﬁ", "日本語 テスト 123 ４５", "🙂🙂 ok", "x" * 5000]


def texts(n=300):
    rnd = random.Random(4)
    out = list(ODD)
    while len(out) < n:
        out.append("".join(rnd.choice("ab C'sé́ \n\t.,!1 日") for _ in range(rnd.randint(0, 400))))
    return out


def test_encoder_equals_the_library(monkeypatch):
    direct = Tokenizer.from_file(PATH)
    t = texts()
    for limit in (token_files.REMEMBERED, 10):
        monkeypatch.setattr(token_files, "REMEMBERED", limit)
        e = token_files.Encoder(PATH)
        for part in (t[:50], t, t[100:]):
            ids, counts = map(np.concatenate, zip(*e.encode(pa.array(part, pa.string()), 2), strict=True))
            ends = np.cumsum(counts)
            for x, a, b in zip(part, ends - counts, ends, strict=True):
                assert list(ids[a:b]) == [*direct.encode(x or "", add_special_tokens=False).ids, 2], x


def test_round_trip(spark):
    direct = Tokenizer.from_file(PATH)
    t = texts(120)
    rows = [(i, x) for i, x in enumerate(t)] + [(7, t[7]), (None, "no key"), (-5, "first")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, ids string, part int").repartition(6)
    folder = token_files.write(docs, PATH, 2)
    got = sorted(token_files.digest(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*direct.encode(x or "", add_special_tokens=False).ids, 2] for _, x in want]
    assert [r.doc_id for r in got] == [k for k, _ in want]
    assert [r.n_tokens for r in got] == list(map(len, ids))
    assert [r.start for r in got] == list(np.cumsum([0, *map(len, ids)])[:-1])
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    back = {r.doc_id: r.ids for r in token_files.texts_of(spark, folder).collect()}
    assert back == {k: i for (k, _), i in zip(want, ids, strict=True)}
    assert token_files.digest(spark, token_files.write(docs.limit(0), PATH, 2)).count() == 0


def test_a_tokenizer_across_white_space_is_an_error(spark, tmp_path):
    own = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "a b": 3}, "[UNK]"))
    own.save(f"{tmp_path}/own.json")
    token_files.Encoder(f"{tmp_path}/own.json").check("a")
    with pytest.raises(ValueError, match="independently"):
        token_files.Encoder(f"{tmp_path}/own.json").check("a b")
    with pytest.raises(ValueError, match="independently"):
        token_files.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"{tmp_path}/own.json", 2)
