"""Metric export requests in the binary wire format of the public protocol definition: gauges, sums, histograms."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from meterflow.sources.remote_write import _field, _signed, compress, decompress, fields

# Field numbers fixed by the public protocol definition.
RESOURCE_METRICS, RESOURCE, SCOPE_METRICS, METRICS = 1, 1, 2, 2
NAME, UNIT, KINDS = 1, 3, {5: "gauge", 7: "sum", 9: "histogram"}
TEMPORALITY = {0: None, 1: "delta", 2: "cumulative"}
POINT_ATTRIBUTES = {"gauge": 7, "sum": 7, "histogram": 9}


def _attributes(labels: dict[str, str], number: int) -> bytes:
    return b"".join(_field(number, _field(1, k.encode()) + _field(2, _field(1, v.encode()))) for k, v in sorted(labels.items()))


def _attribute(body: bytes) -> tuple[str, str]:
    """Key and string value; values of other types read as empty."""
    key, value = "", ""
    for n, kind, v in fields(body):
        if n == 1 and kind == 2:
            key = v.decode()
        elif n == 2 and kind == 2:
            value = next((x.decode() for m, w, x in fields(v) if m == 1 and w == 2), "")
    return key, value


def encode_request(points: list[tuple[dict[str, str], str, str, dict[str, str], int, float]]) -> bytes:
    """points: resource, name, unit, labels, nanoseconds, value; a gauge each, under one resource entry a run of equal resources."""
    out, at = [], 0
    while at < len(points):
        resource, end = points[at][0], at
        while end < len(points) and points[end][0] == resource:
            end += 1
        metrics = b""
        for _, name, unit, labels, ts, value in points[at:end]:
            point = b"\x19" + struct.pack("<Q", ts) + b"\x21" + struct.pack("<d", value) + _attributes(labels, 7)
            metrics += _field(METRICS, _field(NAME, name.encode()) + _field(UNIT, unit.encode()) + _field(5, _field(1, point)))
        out.append(_field(RESOURCE_METRICS, _field(RESOURCE, _attributes(resource, 1)) + _field(SCOPE_METRICS, metrics)))
        at = end
    return b"".join(out)


def _point(kind: str, body: bytes) -> tuple[dict[str, str], int, float | None]:
    labels, ts, value = {}, 0, None
    for n, w, v in fields(body):
        if n == POINT_ATTRIBUTES[kind] and w == 2:
            k, text = _attribute(v)
            labels[k] = text
        elif n == 3 and w == 1:
            ts = struct.unpack("<Q", v)[0]
        elif kind != "histogram" and n == 4 and w == 1:
            value = struct.unpack("<d", v)[0]
        elif kind != "histogram" and n == 6 and w == 1:
            value = float(struct.unpack("<q", v)[0])
        elif kind == "histogram" and n == 5 and w == 1:
            value = struct.unpack("<d", v)[0]
    return labels, ts, value


def decode_request(data: bytes):
    """(resource, name, unit, kind, temporality, is_monotonic, labels, nanoseconds, value) of each datapoint."""
    for n, w, rm in fields(data):
        if n != RESOURCE_METRICS or w != 2:
            continue
        resource, scopes = {}, []
        for m, x, v in fields(rm):
            if m == RESOURCE and x == 2:
                resource = dict(_attribute(a) for k, y, a in fields(v) if k == 1 and y == 2)
            elif m == SCOPE_METRICS and x == 2:
                scopes.append(v)
        for metric in (v for s in scopes for k, y, v in fields(s) if k == METRICS and y == 2):
            name = unit = ""
            for k, y, v in fields(metric):
                if y != 2:
                    continue
                if k == NAME:
                    name = v.decode()
                elif k == UNIT:
                    unit = v.decode()
                elif k in KINDS:
                    kind, points, temporality, monotonic = KINDS[k], [], None, False
                    for p, z, body in fields(v):
                        if p == 1 and z == 2:
                            points.append(body)
                        elif p == 2 and z == 0:
                            temporality = TEMPORALITY.get(_signed(body))
                        elif p == 3 and z == 0:
                            monotonic = bool(body)
                    for body in points:
                        yield (resource, name, unit, kind, temporality, monotonic, *_point(kind, body))


def encode(points: DataFrame, by: str = "batch_id", encoding: str = "gzip") -> DataFrame:
    """(by, encoding, body): one request for each value of by."""
    kind = dict(points.dtypes)[by]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("dp_id")
        rows = [(dict(r), n, u, dict(m), int(t), float(v)) for r, n, u, m, t, v in zip(pdf["resource"], pdf["name"], pdf["unit"], pdf["labels"], pdf["ts_ns"], pdf["value"])]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "encoding": [encoding], "body": [compress(encode_request(rows), encoding)]})

    return points.select(by, "dp_id", "resource", "name", "unit", "labels", "ts_ns", "value").groupBy(by).applyInPandas(run, f"{by} {kind}, encoding string, body binary")


def decode(bodies: DataFrame, most: int = 64 << 20) -> DataFrame:
    """One row a datapoint of requests in columns encoding and body. A body that is cut short fails its task."""
    cols = ["resource", "name", "unit", "kind", "temporality", "is_monotonic", "labels", "ts_ns", "value"]

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for e, b in zip(pdf["encoding"], pdf["body"]):
                yield pd.DataFrame(list(decode_request(decompress(bytes(b), e, most))), columns=cols)

    return bodies.select("encoding", "body").mapInPandas(run, "resource map<string,string>, name string, unit string, kind string, temporality string, is_monotonic boolean, labels map<string,string>, ts_ns long, value double")
