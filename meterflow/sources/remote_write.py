"""Remote-write requests: the wire format of their messages, block compression, rows of series and samples."""

from __future__ import annotations

import gzip
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def fields(data: bytes):
    """(number, wire type, value) of a message; lengths and ends are checked."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= end or shift > 63:
                raise ValueError("a number runs past the end of its message")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, 0, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > end:
            raise ValueError("a field runs past the end of its message")
        yield tag >> 3, kind, data[at : at + size]
        at += size


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def encode_request(series: list[tuple[list[tuple[str, str]], list[tuple[float, int]]]]) -> bytes:
    """series: labels (sorted here) and samples (value, milliseconds)."""
    out = []
    for labels, samples in series:
        body = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in sorted(labels))
        body += b"".join(_field(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _varint(t)) for v, t in samples)
        out.append(_field(1, body))
    return b"".join(out)


def decode_request(data: bytes) -> list[tuple[list[tuple[str, str]], list[tuple[float, int]], int, int]]:
    """(labels, samples, exemplars, histograms) of each series; the last two are counts."""
    out = []
    for number, kind, body in fields(data):
        if number != 1 or kind != 2:
            continue
        labels, samples, others = [], [], [0, 0]
        for n, k, part in fields(body):
            if n == 1 and k == 2:
                got = {m: v for m, w, v in fields(part) if w == 2}
                labels.append((got.get(1, b"").decode(), got.get(2, b"").decode()))
            elif n == 2 and k == 2:
                value, ts = 0.0, 0
                for m, w, v in fields(part):
                    if m == 1 and w == 1:
                        value = struct.unpack("<d", v)[0]
                    elif m == 2 and w == 0:
                        ts = _signed(v)
                samples.append((value, ts))
            elif n in (3, 4) and k == 2:
                others[n - 3] += 1
        out.append((labels, samples, *others))
    return out


def compress(data: bytes, encoding: str) -> bytes:
    import pyarrow as pa

    if encoding in ("", "none", "identity"):
        return data
    if encoding == "gzip":
        return gzip.compress(data, mtime=0)
    if encoding == "zlib":
        return zlib.compress(data)
    if encoding == "deflate":
        c = zlib.compressobj(wbits=-15)
        return c.compress(data) + c.flush()
    if encoding == "zstd":
        import zstandard

        return zstandard.compress(data)
    if encoding == "snappy":
        return pa.compress(data, codec="snappy", asbytes=True)
    raise ValueError(f"unknown encoding {encoding!r}")


def _snappy_size(data: bytes) -> int:
    out = shift = 0
    for b in data[:5]:
        out |= (b & 127) << shift
        if b < 128:
            return out
        shift += 7
    raise ValueError("not a snappy block")


def _inflated(data: bytes, bits: int, most: int) -> bytes:
    """All members of a deflated body, most + 1 bytes at the greatest; one that ends early is refused."""
    out, rest = b"", data
    while True:
        d = zlib.decompressobj(wbits=bits)
        try:
            out += d.decompress(rest, most + 1 - len(out))
        except zlib.error as broken:
            raise ValueError(str(broken)) from broken
        if len(out) > most:
            return out
        if not d.eof:
            raise ValueError("the body is cut off")
        rest = d.unused_data
        if not rest or bits != 31:  # only gzip has members
            return out


def decompress(data: bytes, encoding: str, most: int = 64 << 20) -> bytes:
    """The body of a request; one that grows beyond most is refused before it is held."""
    import pyarrow as pa

    if encoding in ("", "none", "identity"):
        out = data
    elif encoding in ("gzip", "zlib", "deflate"):
        out = _inflated(data, {"gzip": 31, "zlib": 15, "deflate": -15}[encoding], most)
    elif encoding == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
            out = r.read(most + 1)
        rest = data if len(out) <= most else b"."
        while len(out) <= most and (rest or not data):  # bounded now: each frame must have its end
            d = zstandard.ZstdDecompressor().decompressobj()
            d.decompress(rest)
            if not d.eof:
                raise ValueError("the body is cut off")
            rest = d.unused_data
    elif encoding == "snappy":
        if (size := _snappy_size(data)) > most:
            raise ValueError("the body is too long")
        out = pa.decompress(data, size, codec="snappy", asbytes=True)
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    if len(out) > most:
        raise ValueError("the body is too long")
    return out


def encode(points: DataFrame, by: str = "batch_id", encoding: str = "snappy") -> DataFrame:
    """(by, encoding, body): one request for each value of by."""
    kind = dict(points.dtypes)[by]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("dp_id")
        series = [([("__name__", n), *dict(m).items()], [(float(v), int(t) // 1_000_000)]) for n, m, v, t in zip(pdf["name"], pdf["labels"], pdf["value"], pdf["ts_ns"])]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "encoding": [encoding], "body": [compress(encode_request(series), encoding)]})

    return points.select(by, "dp_id", "name", "labels", "value", "ts_ns").groupBy(by).applyInPandas(run, f"{by} {kind}, encoding string, body binary")


def decode(bodies: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(series_pos, name, labels, n, samples, exemplars, histograms) of requests in columns encoding and body."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for e, b in zip(pdf["encoding"], pdf["body"]):
                for i, (labels, samples, ex, hi) in enumerate(decode_request(decompress(bytes(b), e, most))):
                    own = dict(labels)
                    name = own.pop("__name__", "")
                    rows.append((i, name, own, len(samples) + ex + hi, [{"value": v, "ts_ms": t} for v, t in samples], ex, hi))
            yield pd.DataFrame(rows, columns=["series_pos", "name", "labels", "n", "samples", "exemplars", "histograms"])

    return bodies.select("encoding", "body").mapInPandas(run, "series_pos long, name string, labels map<string,string>, n long, samples array<struct<value:double,ts_ms:long>>, exemplars long, histograms long")


def samples(series: DataFrame) -> DataFrame:
    """One row a sample."""
    return series.select("name", "labels", F.explode("samples").alias("s")).select("name", "labels", "s.value", (F.col("s.ts_ms") * 1_000_000).alias("ts_ns"))


def version(exemplars, histograms):
    """2.0 where a series has histograms or exemplars, else 1.0."""
    return F.when((exemplars > 0) | (histograms > 0), "2.0").otherwise("1.0")
