"""Content-addressed assets: accepting what was fetched, storing each payload once, rewriting trees to local routes, and what nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import binary, urls
from kilnwork.functions.text import media_type


def accepted(fetched: DataFrame, allow_raster: bool = True, allow_pdf: bool = True, max_bytes: int = 20 << 20) -> DataFrame:
    """(url, kind, name, payload, error) of fetched resources (url, kind, declared_type, payload, media_type)."""
    known = fetched.withColumn("_ext", binary.extension(F.col("payload")))
    error = binary.acceptance_error(F.col("kind"), F.col("declared_type"), F.col("payload"), media_type(F.col("media_type")), F.col("_ext"), allow_raster, allow_pdf, max_bytes)
    told = known.withColumn("error", error)
    name = F.concat(binary.digest(F.col("payload")), F.lit("."), F.col("_ext"))
    return told.select("url", "kind", F.when(F.col("error").isNull(), name).alias("name"), F.when(F.col("error").isNull(), F.col("payload")).alias("payload"), "error")


def store(payloads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, payload) to write: each name once, none that exists. A name whose stored bytes differ is an error of the row, `existing-asset-mismatch`."""
    once = payloads.filter("name IS NOT NULL").groupBy("name").agg(F.first("payload").alias("payload")).withColumn("error", F.lit(None).cast("string"))
    if existing is None:
        return once
    held = existing.select("name", F.sha2("payload", 256).alias("_held"))
    rows = once.join(held, "name", "left")
    return rows.filter("_held IS NULL OR _held <> substring(name, 1, 64)").select("name", "payload", F.when(F.col("_held").isNotNull(), "existing-asset-mismatch").alias("error"))


def unsupported(src: Column, known_missing: Column) -> Column:
    """A picture that is not fetched: no address, known to be gone, or a drawing in SVG."""
    path = F.coalesce(F.try_url_decode(F.regexp_extract(src, r"^[^?#]*", 0)), F.lit(""))
    return src.isNull() | known_missing | F.lower(path).endswith(".svg") | urls.remote_resource(src).isNull()


def localised(nodes: DataFrame, fetched: DataFrame, content_kind: str, known_missing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Trees with local routes in place of remote addresses, and (doc_id, error) of documents that cannot be.

    Pictures that are not fetched become missing_asset. fetched: what accepted() gives; each address is looked up once, however many nodes name it.
    """
    kind = F.col("kind")
    url = F.when(kind == "image", F.col("attrs")["src"]).when(kind == "attachment", F.col("attrs")["href"])
    rows = nodes.withColumn("_url", url)
    if known_missing is not None:
        rows = rows.join(known_missing.select(F.col("url").alias("_url")).distinct().withColumn("_gone", F.lit(True)), "_url", "left")
    else:
        rows = rows.withColumn("_gone", F.lit(False))
    found = fetched.groupBy("url").agg(F.max("name").alias("_name"), F.max("error").alias("_error")).withColumnRenamed("url", "_url")
    rows = rows.join(found, "_url", "left")
    is_asset = kind.isin("image", "attachment")
    drop = (kind == "image") & unsupported(F.col("_url"), F.coalesce("_gone", F.lit(False)))
    route = F.concat(F.lit(urls.ROUTES[content_kind]), F.col("_name"))
    key = F.when(kind == "image", "src").otherwise("href")
    changed = F.map_concat(F.map_filter("attrs", lambda k, _: k != key), F.map_from_arrays(F.array(key), F.array(route)))
    attrs = F.when(drop, F.map_filter("attrs", lambda k, _: k == "alt")).when(is_asset & F.col("_name").isNotNull(), changed).otherwise(F.col("attrs"))
    out = rows.withColumns({"attrs": attrs, "kind": F.when(drop, "missing_asset").otherwise(kind), "_bad": F.when(is_asset & ~drop & F.col("_name").isNull(), F.when(F.col("_url").isNull() | (F.col("_url") == ""), "missing-resource-url").otherwise(F.coalesce("_error", F.lit("asset-fetch-failed"))))})
    errors = out.filter("_bad IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("path", "_bad")).alias("_e")).select("doc_id", F.col("_e._bad").alias("error"))
    return out.select(*nodes.columns), errors


def references(nodes: DataFrame, content_kind: str) -> DataFrame:
    """(doc_id, name, first): the stored assets that trees refer to, titles of spoilers included, with the path of the first mention."""
    kind = F.col("kind")
    route = F.when(kind == "image", F.col("attrs")["src"]).when(kind == "attachment", F.col("attrs")["href"])
    name = urls.route_name(route, F.lit(content_kind))
    rows = nodes.withColumn("name", name).filter(urls.asset_digest(F.col("name")).isNotNull())
    return rows.groupBy("doc_id", "name").agg(F.min("path").alias("first"))


def broken(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """References to assets that are not stored, or whose bytes are not those of their name and kind."""
    good = stored.filter((F.sha2("payload", 256) == F.substring_index("name", ".", 1)) & (binary.extension(F.col("payload")) == F.replace(F.substring_index("name", ".", -1), F.lit("jpeg"), F.lit("jpg"))))
    return refs.join(good.select("name"), "name", "left_anti")


def orphans(stored: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored assets that nothing refers to: what garbage collection removes."""
    return stored.join(refs.select("name"), "name", "left_anti").select("name", F.octet_length("payload").alias("bytes"))


def collected(gone: DataFrame) -> DataFrame:
    return gone.agg(F.count("*").alias("removed_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("removed_bytes"))
