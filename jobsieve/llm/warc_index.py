"""WARC archives with an external index merge.

Every writing task sorts its captures, writes them as gzip records of WARC files, and leaves one sorted run of index
entries per file. The runs are dealt out by ranges of (URL key, time, id), and in each range the ascending runs are
merged by a loser tree: the index is then one globally ordered capture history, and records are read back by it.
"""

from __future__ import annotations

import base64
import gzip
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.store import open_fs, shared_dir, stored

MIN_BYTES = 0
FILE_BYTES = 128 << 20
NO_TIME = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, ts string, id string, copy long, file string, offset long, length long"
BATCH = 4096


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host, then path and query; scheme, fragment, case of the host do not count."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, copy: int, response: bool) -> bytes:
    """One WARC record, as a gzip member of its own. The HTTP block of a revisit keeps the full payload's length."""
    payload = row["html"].encode() if response else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    name = lambda i, n: f"<urn:capture:{quote('' if i is None else '=' + str(i), safe='')}:{n}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {name(row['id'], copy)}",
            f"WARC-Target-URI: {_line(row['url'])}", f"WARC-Date: {row['ts']}", f"WARC-Payload-Digest: sha1:{digest}"]
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(row['refers_to'], 0)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n", 3, mtime=0)


def parse_record(data: bytes) -> dict:
    """What a record says; the payload of a response is digested anew."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response:
        import hashlib

        seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if seen != digest or len(payload) != declared:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def ident(field: str) -> str | None:
        said = unquote(fields[field].removeprefix("<urn:capture:").rpartition(":")[0])
        return said.removeprefix("=") if said else None

    return {"id": ident("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": declared, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": None if response else ident("WARC-Refers-To"), "payload": payload}


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["url_key", "ts", "id", "copy", "file", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        out, name, at, rows = None, "", 0, []
        for batch in batches:
            for row in batch.to_pylist():
                for copy in range(row["copies"]):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        # A fresh name per attempt: a retried task never shares a file, and only returned names are read.
                        name, at = f"captures-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    response = row["small"] or (row["is_first"] and copy == 0)
                    data = record_bytes(row, copy, response)
                    out.write(data)
                    rows.append((row["url_key"], row["ts"], row["id"], copy, name, at, len(data)))
                    at += len(data)
                    if len(rows) >= BATCH:
                        yield _entries(rows)
                        rows = []
        if out is not None:
            out.close()
        yield _entries(rows)

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   ts: Column | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row into ``folder``; returns the stored index entries, sorted within each file.

    Of captures with equal payloads of ``min_bytes`` or more the one with the smallest id (null last, then URL, time) is the
    response. Rows that repeat wholly are combined before anything is shuffled; the first is the response, if it is
    theirs to be. Null html is an empty payload.
    """
    ts = F.coalesce(ts if ts is not None else F.lit(None).cast("string"), F.lit(NO_TIME))
    html = F.coalesce(F.col(html_col), F.lit(""))
    seen = pages.select(F.col(id_col).alias("key_id"), F.col(url_col).alias("url"), ts.alias("ts"), html.alias("html"))
    # One key without nulls for (id, url, time), so that the aggregate and the join below share one shuffle of the html.
    seen = seen.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"),
                       F.to_json(F.struct("key_id", "url", "ts")).alias("capture"))
    keys = ["capture", "digest", "size"]
    slim = stored(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.first("key_id").alias("key_id"),
                                          F.first("url").alias("url"), F.first("ts").alias("ts")), "captures")
    order = F.struct(F.isnull("key_id").alias("n"), "key_id", F.isnull("url").alias("u"), "url", "ts", "capture")
    firsts = stored(slim.groupBy("digest", "size").agg(F.min(order).alias("f"))
                    .select("digest", "size", F.col("f.capture").alias("first_capture"), F.col("f.key_id").alias("refers_to")), "first-captures")
    decided = stored(
        slim.join(firsts, ["digest", "size"])
        .select(*keys, "copies", F.col("refers_to").cast("string").alias("refers_to"),
                (F.col("capture") == F.col("first_capture")).alias("is_first"), (F.col("size") < min_bytes).alias("small")), "decided")
    bodies = seen.groupBy(*keys).agg(F.first("html").alias("html"), F.first("key_id").alias("key_id"),
                                     F.first("url").alias("url"), F.first("ts").alias("ts"))
    rows = bodies.join(decided, keys).select(
        url_key(F.col("url")).alias("url_key"), "ts", "key_id", F.col("key_id").cast("string").alias("id"), "url", "digest", "size",
        "copies", "refers_to", "is_first", "small", F.when(F.col("is_first") | F.col("small"), F.col("html")).alias("html"))
    runs = rows.sortWithinPartitions("url_key", "ts", "id").drop("key_id")
    return stored(runs.mapInArrow(_writer(folder, file_bytes), INDEX), "runs")


_END = (1,)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge ascending runs of tuples: every item costs one path of comparisons from its leaf to the root."""
    k = len(runs)
    step = lambda i: (0, *x) if (x := next(runs[i], None)) is not None else _END
    heads = [step(i) for i in range(k)]
    losers: list[int | None] = [None] * max(k, 1)

    def replay(winner: int) -> None:
        node = (winner + k) // 2
        while node > 0:
            if losers[node] is None:
                losers[node] = winner
                return
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner

    for i in range(k):
        replay(i)
    while k and heads[losers[0]] is not _END:
        best = losers[0]
        yield heads[best][1:]
        heads[best] = step(best)
        replay(best)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one key range. A run begins wherever the key falls, so any arrival order gives a right result."""
    entries = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    key = lambda e: (e[0], e[1], e[2] is None, e[2] or "", e[3], e[4], e[5])
    keyed = [(key(e), i) for i, e in enumerate(entries)]
    starts = [0, *(i for i in range(1, len(keyed)) if keyed[i][0] < keyed[i - 1][0]), len(keyed)]
    order = loser_tree([iter(keyed[a:b]) for a, b in zip(starts, starts[1:], strict=False) if b > a])
    rows = []
    for _, i in order:
        rows.append(entries[i])
        if len(rows) >= BATCH:
            yield _entries(rows)
            rows = []
    yield _entries(rows)


def merge_index(runs: DataFrame) -> DataFrame:
    """All runs as one index in order of (URL key, time, id, copy), stored. A URL with very many captures is split, since
    ranges are cut by the whole key; a task holds the slim entries of one range only."""
    ranged = runs.repartitionByRange("url_key", "ts", F.col("id").asc_nulls_last(), "copy", "file", "offset")
    return stored(ranged.mapInArrow(_merge, INDEX), "capture-index")


READ = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, url_key string, ts string"


def _reader(folder: str, payloads: bool):
    def read(entries: pd.DataFrame) -> pd.DataFrame:
        files, root = open_fs(folder)
        rows = []
        with files.open_input_file(f"{root}/{entries['file'].iloc[0]}") as source:
            for e in entries.sort_values("offset").itertuples(index=False):
                source.seek(e.offset)
                said = parse_record(source.read(e.length))
                rows.append((*list(said.values())[:6], e.url_key, e.ts, *([said["payload"]] if payloads else [])))
        names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", *["payload"] * payloads]
        return pd.DataFrame(rows, columns=names)

    return read


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` names, one row each. A group is one file, which the writer ends at ``file_bytes``."""
    return index.groupBy("file").applyInPandas(_reader(folder, payloads), READ + ", payload binary" * payloads)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None,
            min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Write, merge and read back: ``(records, index, folder)``. An empty table gives no files, entries or records."""
    folder = shared_dir(pages.sparkSession, "warc")
    index = merge_index(write_archives(pages, folder, id_col, url_col, html_col, ts, min_bytes, file_bytes))
    return read_archives(index, folder), index, folder
