"""Books in zip archives: the documents of the package's reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spanloom.functions.dialect import struct_of

ITEMS = ArrayType(struct_of("name:string html:string"))
MARKUP = (".xhtml", ".html", ".htm")


def member(z: zipfile.ZipFile, name: str) -> bytes | None:
    """A member's bytes; None if it is encrypted, damaged, or packed in a way that is not known."""
    try:
        return z.read(name)
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, KeyError):
        return None


def reading_order(z: zipfile.ZipFile) -> list[str]:
    """Names of an archive's documents: those of the spine but its navigation and cover, else the manifest's, else all by name."""
    names = z.namelist()
    order: list[str] = []
    package = next((n for n in names if n.endswith(".opf")), None)
    if package:
        try:
            root = ElementTree.fromstring(member(z, package) or b"")
            of = {e.get("id"): (e.get("href", ""), e.get("media-type", "")) for e in root.iter() if e.tag.endswith("}item")}
            place = lambda i: posixpath.normpath(posixpath.join(posixpath.dirname(package), of[i][0]))
            spine = [e.get("idref") for e in root.iter() if e.tag.endswith("}itemref")]
            order = [place(i) for i in spine if i in of and i.lower() not in ("nav", "cover")] or [place(i) for i in of if "html" in of[i][1]]
        except ElementTree.ParseError:
            order = []
    return [n for n in order if n in names] or sorted(n for n in names if n.lower().endswith(MARKUP))


def items(data: bytes | None) -> list[dict]:
    """The documents of an archive as (name, html), in reading order.

    What is no archive has none, and members that can't be read are left out.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
    except zipfile.BadZipFile:
        return []
    return [{"name": n, "html": html.decode("utf-8", "ignore")} for n in reading_order(z) if (html := member(z, n)) is not None]


@F.pandas_udf(ITEMS)
def items_udf(data: pd.Series) -> pd.Series:
    return data.map(items)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, name, html) of all archives at ``path``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return raw.select("path", F.posexplode(items_udf("content")).alias("ord", "i")).select("path", "ord", "i.name", "i.html")


#: Names of covers beside a book, in the order in which they are taken, and suffixes of images (fixed values).
COVERS = ("cover.jpg", "cover.jpeg", "cover.png", "cover.webp")
STEMS, IMAGES = ("cover", "folder", "front"), (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")


def cover_rank(name: str) -> str:
    """SQL text for the rank of a file as its folder's cover; null if it can't be one. Equal ranks go by name."""
    low = f"lower({name})"
    exact = [*COVERS, *(s + e for s in STEMS for e in IMAGES)]
    tests = [f"when {name} = '{n}' then {k}" for k, n in enumerate(exact)]
    image = " or ".join(f"{low} like '%{e}'" for e in IMAGES)
    return f"case {' '.join(tests)} when not ({image}) then null when {low} like 'cover%' then 100 when {low} like '%cover%' then 101 when {low} like 'folder%' then 102 when {low} like '%folder%' then 103 end"


def covers(files: DataFrame, most: int = 10 << 20) -> DataFrame:
    """(folder, name): the cover of each folder, from (folder, name, length); files of over ``most`` bytes and empty ones are none."""
    t = files.where((F.col("length") > 0) & (F.col("length") <= most)).withColumn("rank", F.expr(cover_rank("name"))).where("rank is not null")
    return t.groupBy("folder").agg(F.min_by("name", F.struct("rank", F.lower("name"), "name")).alias("name"))


def image_links(html: str) -> list[str]:
    """Places of the images that a document shows."""
    return re.findall(r"""(?i)<(?:img|image)\b[^>]*?\b(?:src|xlink:href|href)\s*=\s*["']([^"']+)""", html)


def cover_image(data: bytes | None) -> bytes | None:
    """The cover in an archive: the first image that its cover document shows, else the first image, one named so before others."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
    except zipfile.BadZipFile:
        return None
    names = z.namelist()
    for n in (n for n in names if "cover" in n.lower() and n.lower().endswith(MARKUP)):
        for link in image_links((member(z, n) or b"").decode("utf-8", "ignore")):
            at = posixpath.normpath(posixpath.join(posixpath.dirname(n), link))
            if at in names:
                return member(z, at)
    images = sorted((n for n in names if n.lower().endswith(IMAGES)), key=lambda n: ("cover" not in n.lower(), names.index(n)))
    return member(z, images[0]) if images else None
