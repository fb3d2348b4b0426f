"""Raw page bodies and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the character sets that are read, bare of punctuation.
UTF_8 = ("utf8",)
ASCII = ("ascii", "usascii")
LATIN_1 = ("latin1", "iso88591")
WINDOWS_1252 = ("windows1252", "win1252", "cp1252")
LATIN_9 = ("latin9", "iso885915")
UTF_16 = {"utf16": "", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "ucs2": "", "utf32": "", "utf32le": "UTF-32LE", "utf32be": "UTF-32BE"}
CHARSETS = UTF_8 + ASCII + LATIN_1 + LATIN_9 + WINDOWS_1252 + tuple(UTF_16)

# Windows-1252 is ISO-8859-1 but for the bytes of its control characters.
_CONTROLS = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))


# ISO-8859-15 is ISO-8859-1 but for eight signs.
_REPLACED = bytes(b for b in range(0xA0, 0x100) if bytes([b]).decode("iso8859-15") != chr(b))


def _name(charset: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(charset, F.lit("utf-8"))), "[^a-z0-9]", "")


def _wide(body: Column, name: Column) -> Column:
    """UTF-16 and UTF-32: the byte order is the name's, else the mark's, else least byte first (UTF-32: highest).

    The bytes pass the JVM's decoder for escaped text, which puts U+FFFD for what is no text, where the one for
    whole bodies would end the job.
    """
    named = F.lit(None).cast("string")
    for own, kind in UTF_16.items():
        if kind:
            named = F.when(name == own, kind).otherwise(named)
    short = F.when(F.hex(F.substring(body, 1, 2)) == "FEFF", "UTF-16BE").otherwise("UTF-16LE")
    mark = F.hex(F.substring(body, 1, 4))
    long = F.when(mark == "FFFE0000", "UTF-32LE").otherwise("UTF-32BE")
    kind = F.coalesce(named, F.when(name.startswith("utf32"), long).otherwise(short))
    escaped = F.regexp_replace(F.hex(body), "(..)", "%$1")
    text = F.reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), F.coalesce(escaped, F.lit("")), kind)
    return F.when(body.isNotNull(), F.ltrim(text, F.lit("\ufeff")))


def _decoded(body: Column, name: Column) -> Column:
    """Bytes that are no text become U+FFFD: a broken page must not end the job, as decode would for UTF-8."""
    latin = F.decode(body, "ISO-8859-1")
    windows = F.translate(latin, _CONTROLS.decode("latin-1"), _CONTROLS.decode("cp1252"))
    return (
        F.when(name.isin(*UTF_8), F.ltrim(F.make_valid_utf8(body.cast("string")), F.lit("\ufeff")))
        .when(name.isin(*LATIN_1), latin)
        .when(name.isin(*WINDOWS_1252), windows)
        .when(name.isin(*LATIN_9), F.translate(latin, _REPLACED.decode("latin-1"), _REPLACED.decode("iso8859-15")))
        .when(name.isin(*UTF_16), _wide(body, name))
        .when(name.isin(*ASCII), F.regexp_replace(latin, "[^\\x00-\\x7F]", "\ufffd"))
    )


def decode_pages(df: DataFrame, body_col: str = "body", charset_col: str = "charset") -> DataFrame:
    """Replace the body bytes by ``html``. Without a charset UTF-8 is read; ``rejected`` marks others.

    ``entities`` tells whether entities still are to be decoded: only without a charset.
    """
    name = _name(F.col(charset_col))
    return (
        df.withColumn("html", _decoded(F.col(body_col), name))
        .withColumn("entities", F.col(charset_col).isNull())
        .withColumn("rejected", ~name.isin(*CHARSETS))
        .drop(body_col)
    )


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files below ``path``; their content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "modificationTime")
