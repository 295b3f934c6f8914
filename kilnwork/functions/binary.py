"""Binary payloads: digests, kinds by their first bytes, and the structure of bitmaps, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def _starts(payload: Column, hexes: str, at: int = 1) -> Column:
    return F.hex(F.substring(payload, at, len(hexes) // 2)) == hexes


def little_endian(payload: Column, at: int, size: int) -> Column:
    """The unsigned integer in `size` bytes from offset `at`."""
    out = F.lit(0).cast("long")
    for k in range(size):
        one = F.conv(F.hex(F.substring(payload, at + 1 + k, 1)), 16, 10).cast("long")
        out = out + one * F.lit(1 << (8 * k))
    return out


def _signed(value: Column) -> Column:
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def valid_bitmap(payload: Column) -> Column:
    """An uncompressed BMP, with either header, whose told size is its own (or one more), and whose palette and rows lie inside it."""
    le = lambda at, size: little_endian(payload, at, size)
    names = {"n": F.octet_length(payload).cast("long"), "told": le(2, 4), "data": le(10, 4), "info": le(14, 4), "a2": le(18, 2), "b2": le(20, 2), "c2": le(22, 2), "d2": le(24, 2)}
    names |= {"a4": _signed(le(18, 4)), "b4": _signed(le(22, 4)), "planes": le(26, 2), "depth": le(28, 2), "packing": le(30, 4), "used": le(46, 4)}
    read = F.struct(*[v.alias(k) for k, v in names.items()])

    def sized(h: Column) -> Column:
        old = h["info"] == 12
        pick = lambda one, two: F.when(old, one).otherwise(two)
        depth = pick(h["d2"], h["depth"])
        fields = {"n": h["n"], "told": h["told"], "data": h["data"], "info": h["info"], "old": old, "width": pick(h["a2"], h["a4"]), "height": pick(h["b2"], h["b4"]), "planes": pick(h["c2"], h["planes"]), "depth": depth, "packing": pick(F.lit(0), h["packing"]), "used": pick(F.lit(0), h["used"])}
        return F.struct(*[v.alias(k) for k, v in fields.items()], F.when(depth <= 8, F.pow(F.lit(2.0), F.greatest(depth, F.lit(0))).cast("long")).otherwise(F.lit(1 << 62)).alias("most"))

    def fits(h: Column) -> Column:
        form = (h["n"] >= 26) & ((h["told"] == h["n"]) | (h["told"] == h["n"] + 1)) & (h["old"] | ((h["info"] >= 40) & (h["n"] >= 14 + h["info"])))
        inside = (h["width"] > 0) & (h["height"] != 0) & (h["planes"] == 1) & h["depth"].isin(1, 4, 8, 16, 24, 32) & (h["packing"] == 0) & (h["used"] <= h["most"])
        entries = F.when((h["depth"] <= 8) & (h["used"] == 0), h["most"]).otherwise(h["used"])
        row = F.floor((h["width"] * h["depth"] + 31) / 32) * 4
        return form & inside & (h["data"] >= 14 + h["info"] + entries * F.when(h["old"], 3).otherwise(4)) & (h["data"] + row * F.abs(h["height"]) <= h["n"])

    # lambdas over arrays of one name what is read once, so that the expression stays small
    told = F.transform(F.transform(F.transform(F.array(read), sized), fits), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(_starts(payload, "424D"), told[0]).otherwise(False)


def extension(payload: Column) -> Column:
    """png, jpg, gif, webp, bmp or pdf by the payload's first bytes; null for others."""
    return (
        F.when(_starts(payload, "89504E470D0A1A0A"), "png").when(_starts(payload, "FFD8FF"), "jpg").when(_starts(payload, "474946383761") | _starts(payload, "474946383961"), "gif")
        .when(_starts(payload, "52494646") & _starts(payload, "57454250", 9), "webp").when(valid_bitmap(payload), "bmp").when(_starts(payload, "255044462D"), "pdf")
    )


# Media types of pictures.
RASTER_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp")


def acceptance_error(kind: Column, declared_type: Column, payload: Column, fetched_type: Column, ext: Column | None = None, allow_raster: bool = True, allow_pdf: bool = True, max_bytes: int = 20 << 20) -> Column:
    """The first reason not to store what was fetched for a node of this kind (image or attachment), null if there is none. ext: extension() of the payload, where it is at hand."""
    ext = extension(payload) if ext is None else ext
    pdf = kind == "attachment"
    out = F.when(payload.isNull() | (F.octet_length(payload) == 0), "empty-asset-payload").when(F.octet_length(payload) > max_bytes, "asset-too-large")
    if not allow_pdf:
        out = out.when(pdf, "pdf-attachments-disabled")
    for test, code in (
        (declared_type == "application/pdf", "invalid-attachment-media-type"), (fetched_type == "application/pdf", "invalid-pdf-media-type"), (ext == "pdf", "invalid-pdf-magic"),
    ):
        out = out.when(pdf & ~F.coalesce(test, F.lit(False)), code)
    out = out.when(~pdf & ((kind != "image") | F.lit(not allow_raster)), "raster-assets-disabled")
    return out.when(~pdf & ~F.coalesce(ext != "pdf", F.lit(False)), "invalid-raster-magic").when(~pdf & ~F.coalesce(fetched_type.isin(*RASTER_TYPES), F.lit(False)), "invalid-raster-media-type")
