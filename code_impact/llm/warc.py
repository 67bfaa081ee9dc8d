"""WARC archives of pages, with an index of captures merged from sorted runs by a loser tree."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import LOWER, UPPER
from code_impact.session import cut_lineage

PRINTABLE = "".join(chr(c) for c in range(33, 127))
INDEX = "url_key string, time string, page_id long, file string, offset long, length long, seq long"


def url_key(url: Column) -> Column:
    """Sortable form of a URL: labels of the lower-cased host from last to first, then the rest; '' for null."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def record(page_id: int | None, url: str | None, time: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. A revisit has the headers of the response and no payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{i}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id if page_id is not None else f'{time} {url} {digest}')}", f"WARC-Date: {time}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=PRINTABLE)}")
    if page_id is not None:
        head.append(f"Capture-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Capture-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> dict:
    """Fields of a record. The digest of a response is taken from its payload and compared with the header."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if version != "WARC/1.1" or (kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest)):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("Capture-ID"), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Capture-ID"), "payload": payload if kind == "response" else None}


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add ``refers_to``: the smallest page_id with an equal payload of at least ``least_bytes``, where it is another page's.

    Digests are counted before they meet, and only digests of several rows are kept; the join back is split where one is hot.
    """
    groups = pages.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut_lineage(groups.where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    joined = pages.join(groups, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None, least_bytes: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row into ``folder`` and return the runs' index (url_key, time, page_id, file, offset, length, seq).

    The payload is the html in UTF-8, null is empty. Each task sorts its rows by URL key, time and id and writes files of about
    ``roll_bytes``; each file is one sorted run. A file's name holds the attempt that wrote it and the index is stored when all
    tasks are done, so files of lost attempts are never read. ``folder`` must be reachable by all executors through
    ``pyarrow.fs``. Of equal payloads the smallest id is the response; rows that repeat that id are responses too. A null id is
    kept as null and can only be a revisit. Rows without ``time``, or with one outside the years 1 to 9999, which a WARC date
    cannot say, get the beginning of 1970.
    """
    said = F.lit(None).cast("timestamp") if time is None else F.when(F.year(time).between(1, 9999), time)
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
        F.coalesce(F.date_format(said, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("time"),
    )
    own = own.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2("payload", 256), "url_key": url_key(F.col("url"))})
    ordered = mark_revisits(own, least_bytes).sortWithinPartitions("url_key", "time", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, file, offset, seq = None, "", 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or offset >= roll_bytes:
                    if out is not None:
                        out.close()
                    file, offset, seq = f"{root}/run-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(file, compression=None)
                member = record(r["page_id"], r["url"], r["time"], r["payload"], r["digest"], r["refers_to"])
                out.write(member)
                rows.append((r["url_key"], r["time"], r["page_id"], file, offset, len(member), seq))
                offset += len(member)
                seq += 1
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["url_key", "time", "page_id", "file", "offset", "length", "seq"])
        if out is not None:
            out.close()

    narrow = ordered.select("page_id", "url", "payload", "time", "digest", "url_key", "refers_to")
    return cut_lineage(narrow.mapInArrow(write, INDEX))


class LoserTree:
    """Merges sorted runs. Inner nodes keep the loser of their match, so each step replays one path from leaf to root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        self.winner = -1
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes before that of ``b``; an empty run comes last, of equal heads the earlier run first."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        left, right = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (left, a) < (right, b)

    def _replay(self, leaf: int) -> None:
        node, held = (leaf + self.size) // 2, leaf
        while node:
            if self.losers[node] < 0:  # still being built: wait here for the other side
                self.losers[node] = held
                return
            if self._before(self.losers[node], held):
                self.losers[node], held = held, self.losers[node]
            node //= 2
        self.winner = held

    def __iter__(self) -> Iterator:
        while self.runs:
            run = self.winner
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._replay(run)


def merge_index(index: DataFrame, rows_a_range: int = 50_000) -> DataFrame:
    """The captures of all runs in one order of URL key, time and id: (url_key, time, page_id, file, offset, length, part, position).

    Runs are cut at common keys into ranges of about ``rows_a_range`` rows; the cut is by all sort columns, so the captures
    of one URL may span ranges. Each range is merged by one task, and ``part``, ``position`` give the order over all ranges.
    Missing ids come first among equal keys.
    """
    ranges = max(1, -(-index.count() // rows_a_range))
    cut = index.repartitionByRange(ranges, "url_key", "time", "page_id", "file", "seq") if ranges > 1 else index.coalesce(1)
    cut = cut.withColumn("part", F.spark_partition_id()).sortWithinPartitions("file", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        part = 0
        for batch in batches:
            for r in batch.to_pylist():
                part = r["part"]
                no_id = r["page_id"] is None
                runs.setdefault(r["file"], []).append((r["url_key"].encode(), r["time"], not no_id, r["page_id"] or 0, r["file"], r["offset"], r["length"]))
        merged = list(LoserTree(list(runs.values())))
        for lo in range(0, len(merged), 4096):
            some = merged[lo : lo + 4096]
            yield pa.RecordBatch.from_pydict(
                {
                    "url_key": [m[0].decode() for m in some],
                    "time": [m[1] for m in some],
                    "page_id": pa.array([m[3] if m[2] else None for m in some], pa.int64()),
                    "file": [m[4] for m in some],
                    "offset": pa.array([m[5] for m in some], pa.int64()),
                    "length": pa.array([m[6] for m in some], pa.int64()),
                    "part": pa.array([part] * len(some), pa.int32()),
                    "position": pa.array(range(lo, lo + len(some)), pa.int64()),
                }
            )

    return cut_lineage(cut.mapInArrow(merge, "url_key string, time string, page_id long, file string, offset long, length long, part int, position long"))


def read_archives(captures: DataFrame, folder: str, payload: bool = False, open_files: int = 64) -> DataFrame:
    """One row per capture, read from its record: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Captures come in URL order, as the records of each file do, so each task reads every file forward.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] not in files:
                    if len(files) >= open_files:
                        files.popitem(last=False)[1].close()
                    files[r["file"]] = store.open_input_file(r["file"])
                files.move_to_end(r["file"])
                file = files[r["file"]]
                file.seek(r["offset"])
                rows.append(parse(file.read(r["length"])))
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            kinds |= {"payload": pa.binary()} if payload else {}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))
        for file in files.values():
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else "")
    return captures.select("file", "offset", "length").mapInArrow(read, schema)
