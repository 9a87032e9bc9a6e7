"""What of a document the shared dictionary is trained on."""

import numpy as np

from gemello.llm import token_binary as t


def test_sample_reaches_all_parts_of_long_documents():
    for n in (4097, 5000, 100_003):
        ids = np.arange(n, dtype="<u4")
        got = np.frombuffer(t.spread(ids.tobytes()), "<u4")
        assert len(got) == t.SAMPLE_BYTES // 4 and got[0] == 0 and got[-1] == n - 1
        assert {k * 16 // n for k in got.tolist()} == set(range(16))
    short = np.arange(4096, dtype="<u4").tobytes()
    assert t.spread(short) == short and t.spread(b"") == b""


def test_the_dictionary_is_made_ready_once(tmp_path):
    import hashlib
    import time

    import zstandard

    from gemello.llm import token_binary

    raw = zstandard.train_dictionary(token_binary.DICT_BYTES, [bytes([k % 251, 0, k % 7, 0]) * 300 + bytes(range(k % 200)) * 4 for k in range(1000)]).as_bytes()
    digest = hashlib.sha256(raw).digest()
    (tmp_path / f"{digest.hex()}.zdict").write_bytes(raw)
    ready, plain = token_binary._dictionary(f"file://{tmp_path}", digest), zstandard.ZstdCompressionDict(raw)
    text = bytes(range(200)) * 20
    frame = zstandard.ZstdCompressor(level=token_binary.LEVEL, dict_data=ready).compress(text)
    assert zstandard.ZstdDecompressor(dict_data=plain).decompress(frame) == text

    def seconds(d):
        began = time.process_time()
        for _ in range(100):
            zstandard.ZstdCompressor(level=token_binary.LEVEL, dict_data=d).compress(text)
        return time.process_time() - began

    assert min(seconds(ready) for _ in range(3)) < min(seconds(plain) for _ in range(3))
