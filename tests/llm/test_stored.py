"""op8_media writes its images, reads them back and returns the tensors; every column against one computed apart."""

import hashlib
import zlib

import numpy as np

from quern.llm import media, queries

SF = "/root/testdata/sf0.001"


def test_media_is_stored_and_read_back(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(queries, "written", lambda df, name, codec=None, real=queries.written: held.setdefault(name, real(df, name, codec)))
    got = queries.op8_media(spark, SF)
    assert set(held) == {"media"} and held["media"].inputFiles()
    images = {r["doc_id"]: bytes(r["media"]) for r in held["media"].collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw, image = texts[r["doc_id"]], images[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and image[:2] == b"\xff\xd8" and b"\xff\xc2" in image
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(image) and r["media_sha256"] == hashlib.sha256(image).hexdigest()
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        mean = ",".join(str(int(rgb[..., k].sum(dtype=np.int64)) * 1000 // rgb[..., k].size) for k in range(3))
        assert r["feature"] == f"rgb8:{r['width']}x{r['height']}:mean={mean}:crc={zlib.crc32(rgb)}"
    tensors = {r["doc_id"]: bytes(r["rgb"]) for r in media.tensors(held["media"], keep=["doc_id"]).collect()}
    assert tensors == {r["doc_id"]: bytes(r["rgb"]) for r in rows}
