"""WARC archives with a two-level capture index.

Records are gzip members of archives; archives are kept as a table of byte ranges (archive, start, data), so any store
that Spark writes can hold them. The index is one line for each capture, sorted by reversed-host key, in compressed blocks
with a sparse directory of first keys. A lookup binary-searches the directory, then the block, then reads the byte range.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_value, stored, tidy

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 256
#: Blocks of the index that one task of a lookup loads at once.
PART_BLOCKS = 2048
#: Parts that a row of a join on a hot page is dealt over.
SALTS = 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed with commas, then `)`, path and query, in lower case: com,example)/a?b=1. Tabs and line ends,
    which part the fields and lines of the index, are percent-encoded."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return one_line(f"){(url or '').lower()}")
    return one_line(f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower())


def one_line(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0a").replace("\r", "%0d")


def record(kind: str, page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit carries no payload."""
    body = HTTP_HEAD + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _sketch(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, n_bytes and the payload deflated, so that what follows moves little."""

    def squeeze(batches):
        for batch in batches:
            ids, urls, html = batch.column(0), batch.column(1), batch.column(2)
            for a in range(0, batch.num_rows, 256):
                own = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in html.slice(a, 256).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, 256), urls.slice(a, 256), pa.array([hashlib.sha1(x).hexdigest() for x in own]), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.compress(x, 1) for x in own], pa.binary())],
                    ["page_id", "url", "digest", "n_bytes", "payload"],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(tidy(squeeze), "page_id long, url string, digest string, n_bytes long, payload binary")


def _dealt_join(rows: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """rows left joined with one (a row for each key) where a key may hold very many of rows: these are dealt over SALTS
    parts by spread, and each row of one goes to all parts."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    each = one.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt__", F.when(F.col(key).isNotNull(), salt)).join(each, [key, "salt__"], "left").drop("salt__")


def write_archives(pages: DataFrame, held: Scratch, least_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Writes a record for each page; returns the tables (archive, start, length, data) and captures
    (url_key, page_id, archive, offset, length).

    Of pages with equal payloads of at least least_bytes, that with the largest page_id is a response, others revisit it
    (rows that repeat that page_id are all responses). Null html is an empty payload, a null url an empty one.
    A page with a null page_id can't be named by a record and gets none. Which pages revisit which is worked out on ids
    and digests alone; a payload moves once, by its page_id, so a common page is no hot key. An empty table gives empty
    tables; other columns are ignored. The tables lie in folders of held and go with them.
    """
    spark = pages.sparkSession
    rows = held.stored(_sketch(pages.where("page_id is not null")), "warc-pages")
    large = rows.where(F.col("n_bytes") >= least_bytes).select("digest", "page_id")
    best = large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = _dealt_join(large, best, "digest", "page_id").where("best is not null and page_id <> best").select("page_id", "digest", "best").distinct()
    typed = rows.join(held.stored(revisits, "warc-revisits"), ["page_id", "digest"], "left")

    def write(batches):
        part, state = None, {"archive": "", "at": 0, "from": 0, "buf": bytearray()}
        for batch in batches:
            captures: list[tuple] = []
            for digest, page_id, url, _, payload, best in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if part is None or state["at"] >= ARCHIVE_BYTES:
                    part = hashlib.sha1(f"{digest} {page_id} {url}".encode()).hexdigest()[:16]
                    if state["buf"]:
                        yield _chunk(state)
                    from pyspark import TaskContext

                    state = {"archive": f"{TaskContext.get().partitionId():06d}-{part}.warc.gz", "at": 0, "from": 0, "buf": bytearray()}
                raw = record("response" if best is None else "revisit", page_id, url, zlib.decompress(payload), digest, best)
                captures.append((url_key(url), page_id, state["archive"], state["at"], len(raw)))
                state["buf"] += raw
                state["at"] += len(raw)
                if len(state["buf"]) >= CHUNK:
                    yield _chunk(state)
            if captures:
                key, ids, names, at, length = zip(*captures, strict=True)
                n = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids, pa.int64()), pa.array(names), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.nulls(n, pa.binary())],
                    ["url_key", "page_id", "archive", "offset", "length", "data"],
                )
        if state["buf"]:
            yield _chunk(state)

    def _chunk(state):
        out = pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([state["archive"]]), pa.array([state["from"]], pa.int64()), pa.array([len(state["buf"])], pa.int64()), pa.array([bytes(state["buf"])], pa.binary())],
            ["url_key", "page_id", "archive", "offset", "length", "data"],
        )
        state["from"] += len(state["buf"])
        state["buf"] = bytearray()
        return out

    made = typed.select("digest", "page_id", "url", "n_bytes", "payload", "best").mapInArrow(tidy(write), "url_key string, page_id long, archive string, offset long, length long, data binary")
    path = held.folder("warc-archives")
    made.withColumn("kind", F.when(F.col("data").isNull(), "capture").otherwise("archive")).write.partitionBy("kind").option("compression", "none").parquet(path)
    schema = "url_key string, page_id long, archive string, offset long, length long, data binary, kind string"
    table = spark.read.schema(schema).parquet(path)
    return table.where("kind = 'archive'").select("archive", F.col("offset").alias("start"), "length", "data"), table.where("kind = 'capture'").select("url_key", "page_id", "archive", "offset", "length")


def build_index(captures: DataFrame, held: Scratch) -> DataFrame:
    """The index: (part, block, first_key, last_key, lines), blocks of sorted lines deflated. A part is a key range of at
    most PART_BLOCKS blocks."""

    def pack(batches):
        from pyspark import TaskContext

        task, block, lines = TaskContext.get().partitionId(), 0, []

        def out():
            part = (task << 32) + block // PART_BLOCKS
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([lines[0].split("\t", 1)[0]]), pa.array([lines[-1].split("\t", 1)[0]]), pa.array([zlib.compress("\n".join(lines).encode(), 6)], pa.binary())],
                ["part", "block", "first_key", "last_key", "lines"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    yield out()
                    block, lines = block + 1, []
        if lines:
            yield out()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return held.stored(ranged.mapInArrow(tidy(pack), "part long, block int, first_key string, last_key string, lines binary"), "warc-index")


class Block:
    """A block of index lines, searched by bisection."""

    def __init__(self, packed: bytes):
        self.rows = [x.split("\t") for x in zlib.decompress(packed).decode().split("\n")]
        self.keys = np.array([x[0] for x in self.rows], object)

    def find(self, key: str) -> list[tuple]:
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return [(int(x[1]), x[2], int(x[3]), int(x[4])) for x in self.rows[a:b]]


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(url_key, page_id, archive, offset, length) of every capture of each distinct key of keys(url_key).

    The first level, one key range for each part (PART_BLOCKS x BLOCK_LINES captures), is broadcast; keys go to their
    parts; there the directory of first keys and then a block are searched by bisection. A key whose captures fill more
    than one part is looked up in each. Null keys find nothing.
    """
    spark = index.sparkSession
    tops = sorted((r["part"], r["a"], r["b"]) for r in index.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).collect())
    firsts, lasts, parts = [t[1] for t in tops], [t[2] for t in tops], [t[0] for t in tops]
    shared = broadcast_value(spark, (firsts, lasts, parts))

    def route(batches):
        import bisect

        firsts, lasts, parts = shared.value
        for batch in batches:
            key, part = [], []
            for k in map(one_line, batch.column(0).to_pylist()):
                for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
                    key.append(k)
                    part.append(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(key, pa.string())], ["part", "url_key"])

    routed = keys.select("url_key").where("url_key is not null").distinct().mapInArrow(tidy(route), "part long, url_key string")

    def search(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        import bisect

        blocks = blocks.sort_by([("block", "ascending")])
        first, last, packed = (blocks.column(c).to_pylist() for c in ("first_key", "last_key", "lines"))
        got: list[tuple] = []
        held: dict[int, Block] = {}
        for k in sorted(wanted.column("url_key").to_pylist()):
            for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k)):
                if i not in held:
                    held = {j: b for j, b in held.items() if j >= i - 1} | {i: Block(packed[i])}
                got += [(k, *x) for x in held[i].find(k)]
        cols = list(zip(*got, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("url_key", "page_id", "archive", "offset", "length"), cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)})

    return index.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(search, "url_key string, page_id long, archive string, offset long, length long")


def read_records(archives: DataFrame, found: DataFrame) -> DataFrame:
    """Range reads: (page_id, record_type, payload_digest, refers_to, payload) of the byte ranges in found."""
    spans = archives.select("archive", "start", "data")
    # which stored range holds an offset: a merge of starts and offsets by archive, without a range join
    marks = archives.select("archive", F.col("start").alias("at"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("long").alias("length"), F.col("start"))
    asked = found.select("archive", F.col("offset").alias("at"), "page_id", "length", F.lit(None).cast("long").alias("start"))
    order = Window.partitionBy("archive").orderBy("at", F.col("start").asc_nulls_last())
    placed = marks.unionByName(asked).withColumn("start", F.last("start", ignorenulls=True).over(order)).where("page_id is not null")

    def read(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        data = chunks.column("data").to_pylist()
        start = chunks.column("start").to_pylist()
        out: list[tuple] = []
        for page_id, at, length in zip(*(asked.column(c).to_pylist() for c in ("page_id", "at", "length")), strict=True) if data else ():
            fields, payload = parse(data[0][at - start[0] : at - start[0] + length])
            ref = fields.get("WARC-Refers-To")
            out.append((page_id, fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(ref[len("<urn:page:") : -1]) if ref else None, payload))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("page_id", "record_type", "payload_digest", "refers_to", "payload"), cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)})

    return spans.groupBy("archive", "start").cogroup(placed.groupBy("archive", "start")).applyInArrow(read, "page_id long, record_type string, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, indexes them, looks every capture up and reads it back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, of the full payload (a revisit's is that of the response it names).
    A page with a null page_id is in no archive; its row is that of a response with its payload. Null html and url are
    empty; repeated rows come back as often as they are there; an empty table gives an empty result; other columns are
    ignored. Tables made on the way are deleted."""
    held = Scratch(pages.sparkSession)
    archives, captures = write_archives(pages, held)
    # a page_id that is repeated is looked up once for each of its captures
    found = lookup(build_index(captures, held), captures)
    seen = read_records(archives, found)
    own = F.when(F.col("record_type") == "response", F.sha1("payload"))
    read = held.stored(seen.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), own.alias("own"), "payload_digest"), "warc-read")
    asked = read.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    target = read.where("record_type = 'response'").join(asked, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to"), F.col("own").alias("digest")).agg(F.max("n").alias("full"))
    revisit = _dealt_join(read.where("record_type = 'revisit'").withColumn("digest", F.col("payload_digest")).withColumn("both", F.struct("refers_to", "digest")), target.select(F.struct("refers_to", "digest").alias("both"), "full"), "both", "page_id")
    html = F.coalesce("html", F.lit(""))
    nameless = pages.where("page_id is null").select(F.col("page_id").cast("long"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    named = read.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", "refers_to").unionByName(
        revisit.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )
    out = stored(named.unionByName(nameless), "warc-round-trip")
    held.clear()
    return out


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as a .warc.gz file into a folder of this machine, range by range; returns the names."""
    import os

    os.makedirs(folder, exist_ok=True)
    names: dict[str, None] = {}
    for row in archives.orderBy("archive", "start").toLocalIterator():
        with open(f"{folder}/{row['archive']}", "ab" if row["archive"] in names else "wb") as f:
            f.write(row["data"])
        names[row["archive"]] = None
    return list(names)


