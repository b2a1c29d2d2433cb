"""WARC archives and their capture index.

Records are built by expressions and written as text whose line separator is
the record separator, so that Spark's own writer makes the archives on any
store. Reading feeds the pieces of a file through a parser that goes by
Content-Length, so payloads may hold separators. The index of each archive is a
capture run sorted by URL key and time; the runs are written, cut into key ranges of
bounded size, and each range's slices of all runs merged by a tree of losers.

Null payloads are empty; a null URL is an empty one; a null page_id is written
as ``<urn:page:null>`` and read as null, and owns no revisits. Of equal payloads of at
least ``least`` bytes the largest page_id is the response. Repeated rows are
records each; payloads may have any length; extra columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

END = "\r\n\r\n"
#: Tasks that the copies of a payload are dealt to, and rows of the index that a task merges.
SALTS, RANGE_ROWS = 32, 200_000
SCHEMA = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, at long, record_bytes long"


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id and the text of its record."""
    p = pages.select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    p = p.withColumn("sha", F.sha1(F.encode("body", "UTF-8"))).withColumn("n", F.octet_length("body").cast("long"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    owners = p.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.collect_set("salt").alias("salts"))
    # a body can have any number of copies: they go to as many tasks as there are salts
    owners = owners.where("copies > 1").select("sha", "n", "owner", F.explode("salts").alias("salt"))
    p = p.join(owners, ["sha", "n", "salt"], "left").withColumn("revisit", F.coalesce(F.col("owner") != F.col("id"), F.lit(False)))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(1704067200 + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.concat(F.lit("Payload-Length: "), F.col("n")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("owner"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))),
    )
    return p.select(F.col("id").alias("page_id"), F.concat(head, F.lit(END), F.when(F.col("revisit"), "").otherwise(F.col("body"))).alias("value"))


def parsed(pieces, run: str):
    """Rows of one archive from its pieces, in order.

    The pieces are put together with the separators between them alone, since
    whether one follows the last piece isn't told. So the last record is whole
    when its payload is, and nothing but line ends may be left after it."""
    import hashlib
    from itertools import chain

    buffer, sep, at = b"", END.encode(), 0
    chunks, have, need = [], 0, 0  # pieces are joined once they hold what the record needs
    number = lambda s: None if s == "<urn:page:null>" else int(s[10:-1])
    for k, piece in enumerate(chain(pieces, [None])):
        last = piece is None
        if not last:
            chunks.append(sep + piece if k else piece)
            have += len(chunks[-1])
            if have < need:
                continue
        buffer, chunks, need = buffer + b"".join(chunks), [], 0
        while buffer.strip(b"\r\n") and (h := buffer.find(sep)) >= 0:
            head = dict(x.split(": ", 1) for x in buffer[:h].decode().split("\r\n")[1:])
            need = h + 4 + int(head["Content-Length"])
            if len(buffer) < need + (0 if last else 4):
                need += 4
                break
            body, buffer, size = buffer[h + 4 : need], buffer[need + 4 :], need
            at, record, need = at + need + 4, at, 0
            revisit = head["WARC-Type"] == "revisit"
            n, sha = (int(head["Payload-Length"]), head["WARC-Payload-Digest"][5:]) if revisit else (len(body), hashlib.sha1(body).hexdigest())
            if sha != head["WARC-Payload-Digest"][5:]:
                raise ValueError(f"payload digest differs in {run}")
            host, _, rest = head.get("WARC-Target-URI", "").split("://", 1)[-1].partition("/")
            yield (",".join(reversed(host.split("."))) + ")/" + rest, head["WARC-Date"], number(head["WARC-Record-ID"]), n, sha, head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None, run, record, size)
        have = len(buffer)
    if buffer.strip(b"\r\n"):
        raise ValueError(f"archive {run} ends within a record")


def batches_of(rows, size: int = 20_000):
    fields = [(a, pa.int64() if b == "long" else pa.string()) for a, b in (x.split() for x in SCHEMA.split(", "))]
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def sort_key(row: tuple) -> tuple:
    """URL key, time and page_id, nulls first as Spark sorts."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives under ``path``, a sorted run an archive; ``at`` and
    ``record_bytes`` tell where a record is in its unpacked archive."""

    def read(batches):
        from itertools import groupby

        pieces = (x for batch in batches for x in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist(), strict=True))
        for run, group in groupby(pieces, key=lambda x: x[0]):
            yield from batches_of(sorted(parsed((v for _, v in group), run), key=sort_key))

    return spark.read.text(path, lineSep=END).select("value", F.input_file_name().alias("run")).mapInArrow(read, SCHEMA)


def merge_runs(runs: list):
    """k-way merge of sorted runs by a tree of losers."""
    k = len(runs)
    its = [iter(r) for r in runs]
    heads = [next(i, None) for i in its]
    before = lambda a, b: heads[b] is None or (heads[a] is not None and (heads[a], a) <= (heads[b], b))
    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if before(a, b) else (b, a)
        return winner

    winner = play(1) if k else -1
    while k and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(its[winner], None)
        node = (winner + k) // 2
        while node:
            if before(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def history(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order of URL key, time and page_id.

    The sorted runs are written once, so that archives aren't parsed again to sample
    the ranges' bounds; a range has about ``range_rows`` rows however many there are,
    since no two rows have one archive and place. A task gets its slice of each run
    and merges them by the tree of losers, a batch at a time."""
    runs = written(index, "warc-runs")
    partitions = max(1, -(-runs.count() // range_rows))

    def merge(batches):
        slices: dict[str, list[list[tuple]]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, new = slices.setdefault(row[7], []), (sort_key(row), row)
                if own and own[-1][-1][0] <= new[0]:
                    own[-1].append(new)
                else:  # blocks of a run can come out of order: each is merged as a run
                    own.append([new])
        yield from batches_of(row for _, row in merge_runs([block for own in slices.values() for block in own]))

    return runs.repartitionByRange(partitions, "url_key", "captured", "page_id", "run", "at").mapInArrow(merge, SCHEMA)


def archived(pages: DataFrame, per_file: int = 20_000) -> str:
    path = scratch(pages.sparkSession, "warc")
    records(pages).select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archived(table(spark, sf_dir, "pages"))
    return history(captures(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
