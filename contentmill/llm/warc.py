"""WARC archives compressed with Zstandard: a writer and a validating reader.

An archive is a dictionary in a leading skippable frame, then one frame for each record.
Archives are written by Spark's own text writer and read by its binary reader, so they may
lie in any file system that Spark reaches. The writer must end each row with a separator;
it is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmill.llm.filters import holds, key_bitmap
from contentmill.llm.skew import join_hot
from contentmill.llm.workspace import Workspace

# Fixed values of the two formats.
FRAME, DICTIONARY_FRAME, SKIPPABLE, SKIPPABLE_MASK = 0xFD2FB528, 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0
SEPARATOR = "P*M\x18\0\0\0\0"
VERSION = "WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Frames of an archive at most, its dictionary included.
ARCHIVE_FRAMES = 8192
#: Expected pages of the dictionary's sample, the bytes of each that it sees, and its size.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 1 << 15
#: Bytes that a Python worker hands on at a time.
HAND_ON = 8 << 20

RECORDS = "archive string, place long, record_type string, record_id string, page string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, error string"


class Malformed(ValueError):
    """An archive or a record that breaks its format."""


def record(page: str | None, url: str | None, digest: str, size: int, payload: bytes | None, refers: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit (``payload`` is None) that refers to a record id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~')}"] if url else []
    head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {SAME_PAYLOAD}"] if refers is not None else []
    head += [f"X-Page-Id: {quote(page)}"] if page is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: str | None, digest: str) -> str:
    x = hashlib.sha256(f"{'' if page is None else 'p' + page}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:32]}>"


def _write_frames(dictionary: bytes, date: str, level: int):
    """Frames of ``page, url, digest, bytes, payload, first`` -> ``frame``, a dictionary at the head of each archive.

    A row whose ``first`` is a page's id refers to that page's record.
    """

    def run(frames):
        lead = DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        out, held, written = [], 0, 0
        for f in frames:
            for page, url, digest, size, payload, first in zip(*(f[c] for c in ("page", "url", "digest", "bytes", "payload", "first")), strict=True):
                if written % ARCHIVE_FRAMES == 0:
                    out.append(lead)
                    written += 1
                refers = None if first is None else record_id(first, digest)
                out.append(press.compress(record(page, url, digest, size, None if refers else payload, refers, date)))
                written, held = written + 1, held + len(out[-1])
                if held >= HAND_ON:
                    yield pd.DataFrame({"frame": out})
                    out, held = [], 0
        if out:
            yield pd.DataFrame({"frame": out})

    return run


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of what the samples share; empty if they are too few for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, date: datetime | None = None, level: int = 3) -> None:
    """Writes a record for each page below ``path``, a folder that all executors reach.

    The payload is the html in UTF-8. Of pages with equal payloads of ``least_bytes`` or
    more, the one with the smallest id is a response and the others revisit it; smaller
    payloads are all responses. Payloads are compared by SHA-256. Digests that occur more
    than once are counted by key and marked in a bitmap of fixed size: a page whose digest
    isn't marked goes to its archive from where it was read, and only the others meet their
    group in a shuffle, in which groups with a large part of the pages aren't moved.
    The dictionary is trained on a bounded sample (``SAMPLE_ROWS``).

    A null html is an empty payload. A page without id revisits if a page with an id has
    its payload; if none has, all are responses, as are rows that repeat the smallest id.
    Rows that repeat an id and a payload share one record id. White space and control
    characters of a url are percent-encoded; a null or empty url is left out. Other columns
    are ignored; an empty table makes archives without records.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "write-warc")
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    same = keyed.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    groups = ws.table(same.where("rows > 1 and first is not null"), "groups")
    bits = spark.sparkContext.broadcast(key_bitmap(groups.select(F.xxhash64("digest").alias("key")), "key"))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(holds(bits.value, key.to_numpy()))

    share = min(1.0, SAMPLE_ROWS / max(1, pages.count()))
    drawn = keyed.where(F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    dictionary = train_dictionary([bytes(r[0]) for r in drawn.select(F.substring("payload", 1, SAMPLE_BYTES)).limit(4 * SAMPLE_ROWS).toLocalIterator()])
    judged = keyed.withColumn("marked", marked(F.xxhash64("digest")))
    met = join_hot(judged.where("marked and bytes >= " + str(least_bytes)), groups, ["digest"], "rows", "left")
    met = met.withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    alone = judged.where("not marked or bytes < " + str(least_bytes)).withColumn("first", F.lit(None).cast(keyed.schema["id"].dataType))
    text = [F.col("id").cast("string").alias("page"), "url", "digest", "bytes", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), F.col("first").cast("string").alias("first")]
    frames = alone.select(*text).unionByName(met.select(*text)).mapInPandas(_write_frames(dictionary, stamp, level), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_FRAMES).text(path)
    ws.drop("groups")


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & SKIPPABLE_MASK == SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME:
        head = data[at : at + 18]
        try:
            checked, end, last = zstandard.get_frame_parameters(head).has_checksum, at + zstandard.frame_header_size(head), 0
        except zstandard.ZstdError as e:
            raise Malformed(f"frame header: {e}") from e
        while not last and end + 3 <= len(data):
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)  # a run of one byte holds just that
        end = end + 4 * checked if last else len(data) + 1
    else:
        raise Malformed("no frame")
    if end > len(data):
        raise Malformed("cut-off frame")
    return end


def leading_dictionary(data: bytes) -> tuple[bytes | None, int]:
    """The dictionary of an archive, itself compressed or not, and where the rest begins."""
    if int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(data, 0)
    known = data[8:end]
    if int.from_bytes(known[:4], "little") == FRAME:
        try:
            known = zstandard.ZstdDecompressor().decompressobj().decompress(known)
        except zstandard.ZstdError as e:
            raise Malformed(f"dictionary: {e}") from e
    return known or None, end


def _agrees(label: str, payload: bytes) -> bool:
    """Whether a labelled digest, in hex or base 32, is the payload's; unknown algorithms pass."""
    name, _, value = label.partition(":")
    if (name := name.lower().replace("-", "")) not in ("sha1", "sha256", "sha512", "md5"):
        return True
    found = hashlib.new(name, payload).digest()
    return value.lower() == found.hex() or value.upper() == base64.b32encode(found).decode()


def parse_record(raw: bytes) -> dict:
    """Fields of one decoded record; ``Malformed`` names what is wrong with its headers or lengths."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not blank or not version.startswith("WARC/"):
        raise Malformed("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Malformed(f"header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if name not in fields:
            raise Malformed(f"no {name}")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()) or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Malformed(f"content-length {length[:20]} of a block of {len(rest) - 4} bytes")
    kind, payload = fields["warc-type"], rest[:-4]
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = payload.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise Malformed("no HTTP header")
    label = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        if "warc-refers-to" not in fields:
            raise Malformed("a revisit without warc-refers-to")
        payload = None
    elif label and not _agrees(label, payload):
        raise Malformed("payload digest differs")
    page, uri = fields.get("x-page-id"), fields.get("warc-target-uri")
    digest = label.partition(":")[2] if payload is None else hashlib.sha256(payload).hexdigest()
    return {"record_type": kind, "record_id": fields["warc-record-id"], "page": page and unquote(page), "target_uri": uri, "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": None if payload is None else len(payload), "payload_digest": digest or None, "payload": payload}


def records_of(data: bytes) -> Iterator[dict]:
    """Records of one archive with their ``place``; what can't be read is a row with ``error``.

    A record that breaks its format doesn't end the archive, a broken frame does.
    """
    at = 0
    try:
        known, at = leading_dictionary(data)
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        while at < len(data):
            end = frame_end(data, at)
            if int.from_bytes(data[at : at + 4], "little") == FRAME:
                try:
                    yield {"place": at} | parse_record(press.decompressobj().decompress(data[at:end]))
                except (Malformed, zstandard.ZstdError) as e:
                    yield {"place": at, "error": str(e)}
            at = end
    except (Malformed, zstandard.ZstdError) as e:
        yield {"place": at, "error": str(e)}


def _read_archives(payloads: bool):
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"place": "int64", "payload_bytes": "Int64"}).astype({c: object for c in columns if c not in ("place", "payload_bytes")}).where(lambda x: x.notna(), None)

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows, held = [], 0
                for r in records_of(bytes(content)):
                    rows.append({"archive": path} | (r if payloads else r | {"payload": None}))
                    held += 1000 + len(rows[-1].get("payload") or b"")
                    if held >= HAND_ON:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return run


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``, one row each (``RECORDS``).

    An archive is read by one task, its records one at a time, decoded with the dictionary
    of its leading skippable frame if it has one. Version, required headers, lengths of
    blocks and digests of payloads are checked; what fails is a row with ``error``.
    ``payloads`` says whether payloads are returned; they are checked either way.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where("length > 0").select("path", "content").mapInPandas(_read_archives(payloads), RECORDS)


def resolve_revisits(records: DataFrame, ws: Workspace) -> DataFrame:
    """Records with ``refers_to``, the page of the record that a revisit refers to, and its payload's size.

    A revisit whose record isn't there, or has another digest, is a row with ``error``. The
    record of a revisit that refers to one with many revisits isn't shuffled.
    """
    keys = records.where("record_type = 'revisit'").groupBy(F.col("refers_to_id").alias("key")).agg(F.count("*").alias("rows"))
    own = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("key")).agg(F.first("page").alias("refers_to"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("digest"))
    targets = ws.table(keys.join(own, "key"), "targets")
    revisits = records.where("record_type = 'revisit'").withColumn("key", F.col("refers_to_id"))
    met = join_hot(revisits, targets, ["key"], "rows", "left")
    wrong = F.when(F.col("size").isNull(), "refers to no record").when(F.col("digest") != F.col("payload_digest"), "differs from the record it refers to")
    met = met.withColumns({"payload_bytes": F.col("size"), "error": F.coalesce("error", wrong)}).select(*records.columns, "refers_to")
    rest = records.where("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    return rest.unionByName(met)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Pages written to archives and read back from them, one row per page.

    Columns: the id, ``payload_bytes``, ``payload_digest`` (SHA-256 in hex), both of the
    full payload, ``record_type`` and ``refers_to`` (the response's id for revisits). Roles
    and odd values are as ``write_warc`` states. A record that can't be read back raises an
    error. The archives are removed once they are read.
    """
    ws = Workspace(pages.sparkSession, "warc")
    write_warc(pages, f"{ws.root}/archives", id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    records = ws.table(read_warc(pages.sparkSession, f"{ws.root}/archives", payloads=False).drop("payload"), "records")
    ws.drop("archives")
    kind = pages.schema[id_col].dataType
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(":", "archive", "place", "error")).cast("string")).otherwise(F.col("record_type"))
    return resolve_revisits(records, ws).select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
