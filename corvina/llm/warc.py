"""Operator 9: WARC archives with an externally merged capture index.

Writers make locally sorted capture runs: an archive of one gzip member per record, and
an index of (URL key, timestamp, page) that can be searched by halving. Reading splits
the key space into ranges by a bounded sample of keys; a task per range merges that
stretch of all runs with a loser tree, streaming, and reads records in that order.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, table

#: Payloads from this size on are stored once; runs merged by one task; keys kept of a run to cut ranges by.
LEAST_SHARED = 1000
FAN_IN = 128
SAMPLE = 256
RANGE_ROWS = 200_000
#: Keys that a payload of many copies is spread over; records fetched together, their compressed bytes, and the gap between two that one read bridges.
SALTS = 16
FETCH_ROWS = 2000
FETCH_BYTES = 16 << 20
READ_GAP = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
Key = tuple[str, str, int]


def url_key(url: Column) -> Column:
    """Canonical key: host parts reversed, then the path; scheme, user, www, default port, fragment and case don't count."""
    u = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[\s\x00-\x1f]", "%20")
    u = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    path = F.substr(u, F.length(host) + 1)
    bare = F.regexp_replace(F.regexp_replace(host, r"^(?:[^@]*@)?(?:www\d*\.)?", ""), r":(?:80|443)?$", "")
    return F.concat(F.array_join(F.reverse(F.split(bare, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def captures(pages: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as captures: key, time, digest, and the page whose equal payload is stored instead.

    Without a timestamp column the time is page_id seconds after 2020-01-01. Of equal
    payloads of at least LEAST_SHARED bytes the largest page_id keeps the payload; every
    row of that page_id does, if it repeats, and every row where all ids are null. A row
    of null page_id else refers to the largest. A payload of any number of copies is
    spread over SALTS keys for its look-up.
    """
    ts = timestamp if timestamp is not None else F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1577836800)
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), url_key(F.col("url")).alias("urlkey"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    ).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    shared = p.filter(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter("n > 1").select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")), "shared")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = p.join(shared, (F.col("digest") == F.col("d")) & (salt == F.col("s")) & (F.octet_length("html") >= LEAST_SHARED), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "urlkey", "ts", "digest", F.octet_length("html").alias("size"), F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _header(value: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def record(page_id: int | None, url: str | None, ts: str, digest: str, size: int, html: str, refers_to: int | None) -> bytes:
    """One WARC record, a response with its payload or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html.encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_header(url)}", f"WARC-Date: {ts}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: page_id, payload_bytes, payload_digest, record_type, refers_to, url, ts. A digest that doesn't fit its payload is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda x: int(x[12:-1]) if len(x) > 13 else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {"page_id": page(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"],
            "refers_to": page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, "url": h["WARC-Target-URI"], "ts": h["WARC-Date"]}


class IndexWriter:
    """A sorted run of index lines and an even sample of its keys, at most SAMPLE of them whatever the run's length."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.path, self.out, self.at, self.n, self.step = path, fs.open_output_stream(path), 0, 0, 1
        self.sample: list[Key] = []
        self.last: Key | None = None

    def add(self, key: Key, where: str) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("an index run must be sorted")
        if self.n % self.step == 0:
            if len(self.sample) == SAMPLE:  # twice as long a step from now on
                self.sample, self.step = self.sample[::2], 2 * self.step
            if self.n % self.step == 0:
                self.sample.append(key)
        line = f"{key[0]}\t{key[1]}\t{key[2]}\t{where}\n".encode("utf-8", "surrogatepass")
        self.out.write(line)
        self.at, self.n, self.last = self.at + len(line), self.n + 1, key

    def close(self) -> dict:
        self.out.close()
        return {"index": self.path, "n": self.n, "bytes": self.at, "sample": ["\t".join(map(str, k)) for k in self.sample]}


MANIFEST = "index string, n bigint, bytes bigint, sample array<string>"


def _key(line: str) -> Key:
    a, b, c = line.split("\t", 3)[:3]
    return a, b, int(c)


def _manifest(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("index", pa.string()), ("n", pa.int64()), ("bytes", pa.int64()), ("sample", pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])


def write_archives(caps: DataFrame, where: str) -> DataFrame:
    """Write a run per partition under ``where``; the manifest of the runs, as a table that outlives executors.

    A repeated task writes files of other names; only those that the manifest names count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(where)
        name = f"{base}/run-{uuid.uuid4().hex}"
        out = index = None
        at = 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, index = fs.open_output_stream(name + ".warc.gz", compression=None), IndexWriter(fs, name + ".idx")
                    info = b"software: corvina\r\nformat: WARC File Format 1.1\r\n"
                    first = _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid4()).encode(), len(info), info))
                    out.write(first)
                    at = len(first)
                data = _member(record(r["page_id"], r["url"], r["ts"], r["digest"], r["size"], r["html"], r["refers_to"]))
                out.write(data)
                index.add((r["urlkey"], r["ts"], -1 if r["page_id"] is None else r["page_id"]), f"{name}.warc.gz\t{at}\t{len(data)}")
                at += len(data)
        if out is not None:
            out.close()
            yield _manifest([index.close()])

    return materialise(caps.sortWithinPartitions("urlkey", "ts", F.coalesce("page_id", F.lit(-1))).mapInArrow(write, MANIFEST), "manifest")


def seek_key(f: IO[bytes], size: int, low: Key, near: int = 1 << 16) -> int:
    """A byte of a sorted run at the start of a line, before every line of ``low`` or above, found by halving the file."""
    a, b = 0, size  # the line that starts at a, if any, is below low, or a is 0
    while b - a > near:
        mid = (a + b) // 2
        f.seek(mid)
        got = b""
        while got.count(b"\n") < 2 and (more := f.read(1 << 12)):
            got += more
        cut = got.find(b"\n") + 1
        end = got.find(b"\n", cut)
        if not cut or end < 0 or mid + cut >= b:
            b = mid
        elif _key(got[cut:end].decode("utf-8", "surrogatepass")) < low:
            a = mid + cut
        else:
            b = mid
    return a


def stream_run(f: IO[bytes], start: int, low: Key | None, high: Key | None) -> Iterator[tuple[Key, str]]:
    """(key, rest of the line) of a run from byte ``start``, within low <= key < high."""
    f.seek(start)
    held = b""
    while True:
        more = f.read(1 << 16)
        *lines, held = (held + more).split(b"\n")
        for raw in lines:
            line = raw.decode("utf-8", "surrogatepass")
            a, b, c, rest = line.split("\t", 3)
            key = (a, b, int(c))
            if low is not None and key < low:
                continue
            if high is not None and key >= high:
                return
            yield key, rest
        if not more:
            return


class LoserTree:
    """Merges sorted streams of (key, value): inner nodes keep the loser of each match, so the next item takes one replay to the root."""

    def __init__(self, streams: list[Iterator[tuple[Key, str]]]) -> None:
        self.streams = streams
        self.k = len(streams)
        self.head = [next(s, None) for s in streams]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return a is not None or (b is None and i < j)
        return a[0] < b[0] or (a[0] == b[0] and i < j)

    def _enter(self, i: int) -> None:
        """First play of leaf ``i``: it waits where no opponent has come yet."""
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple[Key, str]]:
        if not self.k:
            return
        while True:
            i = self.loser[0]
            item = self.head[i]
            if item is None:
                return
            yield item
            self.head[i] = next(self.streams[i], None)
            winner, node = i, (i + self.k) // 2
            while node > 0:
                if self._beats(self.loser[node], winner):
                    winner, self.loser[node] = self.loser[node], winner
                node //= 2
            self.loser[0] = winner


def _merged(where: str, runs: list[tuple[str, int]], low: Key | None, high: Key | None) -> Iterator[tuple[Key, str]]:
    """The range of all runs (path, bytes) in order; each run's place is sought in the run itself."""
    fs, _ = pafs.FileSystem.from_uri(where)
    files = [fs.open_input_file(path) for path, _ in runs]
    starts = [0 if low is None else seek_key(f, size, low) for f, (_, size) in zip(files, runs, strict=True)]
    yield from LoserTree([stream_run(f, at, low, high) for f, at in zip(files, starts, strict=True)])
    for f in files:
        f.close()


def merge_to_fan_in(manifest: DataFrame, where: str, fan_in: int = FAN_IN) -> DataFrame:
    """Merge index runs in groups of ``fan_in``, pass by pass, until one task can merge what is left."""
    while (n := manifest.count()) > fan_in:
        groups = -(-n // fan_in)
        packed = manifest.withColumn("g", F.pmod(F.xxhash64("index"), F.lit(groups))).groupBy("g").agg(F.collect_list(F.struct("index", "bytes")).alias("runs"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = pafs.FileSystem.from_uri(where)
            for batch in batches:
                for r in batch.to_pylist():
                    out = IndexWriter(fs, f"{base}/merged-{uuid.uuid4().hex}.idx")
                    for key, rest in _merged(where, [(x["index"], x["bytes"]) for x in r["runs"]], None, None):
                        out.add(key, rest)
                    yield _manifest([out.close()])

        manifest = materialise(packed.repartition(groups, "g").select("runs").mapInArrow(merge, MANIFEST), "manifest")
    return manifest


def _fetch(fs: pafs.FileSystem, held: list[tuple[Key, str]]) -> list[dict]:
    """The records of some index entries, in their order; each archive is opened once, neighbouring records are read in one go."""
    places: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, rest) in enumerate(held):
        path, at, size = rest.split("\t")
        places.setdefault(path, []).append((int(at), int(size), k))
    out: list[dict] = [{}] * len(held)
    for path, parts in places.items():
        parts.sort()
        with fs.open_input_file(path) as f:
            i = 0
            while i < len(parts):
                j, start, end = i + 1, parts[i][0], parts[i][0] + parts[i][1]
                while j < len(parts) and parts[j][0] - end <= READ_GAP:
                    end = max(end, parts[j][0] + parts[j][1])
                    j += 1
                f.seek(start)
                data = f.read(end - start)
                for at, size, k in parts[i:j]:
                    out[k] = {"urlkey": held[k][0][0]} | parse(zlib.decompress(data[at - start : at - start + size], 31))
                i = j
    return out


READ = "urlkey string, ts string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def read_archives(manifest: DataFrame, where: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every record of the archives, in capture order within each range of (URL key, time, page).

    The driver sees ``fan_in`` runs at most, each with SAMPLE keys at most, and cuts the
    key space by them, so one URL's captures of any number are split like others. A task
    finds its place in each run by halving, holds a buffer per run, and fetches records
    by the thousand: a lost executor costs its ranges, which are read again. Repeated and
    null page_ids (-1 in the index) keep a record each.
    """
    spark = manifest.sparkSession
    manifest = merge_to_fan_in(manifest, where, fan_in)
    got = manifest.collect()
    runs = [(r["index"], r["bytes"]) for r in got]
    marks = sorted((_key(k), r["n"] / len(r["sample"])) for r in got for k in r["sample"])
    total, ranges = sum(r["n"] for r in got), max(1, -(-sum(r["n"] for r in got) // range_rows), min(2 * spark.sparkContext.defaultParallelism, len(marks)))
    cuts, before = set(), 0.0
    for key, weight in marks:
        if int(before * ranges / total) != int((before + weight) * ranges / total):
            cuts.add(key)
        before += weight
    bounds = list(zip([None, *sorted(cuts)], [*sorted(cuts), None], strict=True))
    shared = spark.sparkContext.broadcast((runs, bounds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        names = ["urlkey", "ts", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        runs, bounds = shared.value
        for batch in batches:
            for n in batch.column(0).to_pylist():
                held: list[tuple[Key, str]] = []
                size = 0

                def flush() -> pa.RecordBatch:
                    rows = _fetch(fs, held)
                    return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in zip(names, kinds, strict=True)], names)

                for item in _merged(where, runs, *bounds[n]):
                    held.append(item)
                    size += int(item[1].rpartition("\t")[2])
                    if len(held) == FETCH_ROWS or size > FETCH_BYTES:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(read, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives."""
    where = scratch_path(spark, "warc")
    manifest = write_archives(captures(table(spark, sf_dir, "pages")), where)
    return read_archives(manifest, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS n, sha1(html) AS h FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
