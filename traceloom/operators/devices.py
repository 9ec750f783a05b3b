"""Device documents: every piece of evidence about a device in one ordered array, and what its pieces say together, field by field.

A device is known by its product's bar code, else by the context of its page, else by its material's serial number; a piece with none of them
is a device of its own. A device's order is never taken over from the declaration it is in: how both relate is a field of the piece.

A field of a document has a status: ``conflict`` (more than one value), ``invalid`` (a text that is no day), ``missing`` or ``valid``; with its value if
valid, all different values and all invalid texts, in order.

Cases: blanks are missing values; equal pieces each count; devices with more than ``PART`` pieces are given in parts, dealt by a hash of the declaration, so that no array grows without
bound; each part has the fields of the whole device. ``summaries`` gives one row a device, however many pieces it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import company_flag, flag_value, parse_date, relation, text

PART = 10_000
#: The resolved fields, and the columns of a piece that they come from; whether they are days.
FIELDS = {
    "sales_order": (("sales_order",), False),
    "production_order": (("production_order",), False),
    "model": (("model",), False),
    "factory_date": (("factory_product", "factory_equipment"), True),
    "warranty_end": (("warranty_product", "warranty_equipment"), True),
}


@dataclass(frozen=True)
class DeviceFilter:
    """Empty texts don't filter; a piece must meet all others."""

    company: str = ""
    sales_order: str = ""
    service_order: str = ""
    serial: str = ""

    def matches(self) -> Column:
        found = F.lit(True)
        if (flag := flag_value(self.company)) is not None:
            found = found & (F.col("is_company") == flag)
        if self.sales_order:
            found = found & (F.col("sales_order").eqNullSafe(F.lit(self.sales_order)) | F.col("doa_sales_order").eqNullSafe(F.lit(self.sales_order)))
        if self.service_order:
            found = found & F.array_contains("service_orders", self.service_order)
        if self.serial:
            found = found & (F.col("barcode").eqNullSafe(F.lit(self.serial)) | F.col("material_sn").eqNullSafe(F.lit(self.serial)))
        return F.coalesce(found, F.lit(False))


def pieces(declarations: DataFrame) -> DataFrame:
    """One row a piece of equipment, with its device and how it relates to its declaration."""
    return pieces_of(declarations.select("*", F.posexplode("equipment").alias("place", "e")))


def pieces_of(rows: DataFrame) -> DataFrame:
    """As ``pieces``, of rows with one piece ``e`` each and its ``place`` in the declaration."""
    barcode, context, material = text("e.product"), text("e.context_value"), text("e.material_sn")
    key = F.coalesce(F.concat(F.lit("product:"), barcode), F.concat(F.lit("context:"), context), F.concat(F.lit("material:"), material), F.concat_ws(":", F.lit("unidentified"), "doa_code", F.col("place").cast("string")))
    basis = F.when(barcode.isNotNull(), "product_barcode").when(context.isNotNull(), "product_context").when(material.isNotNull(), "material_sn").otherwise("missing")
    own, parent = text("e.sales_order"), text("sales_order")
    return rows.select(
        key.alias("device"), basis.alias("basis"), "doa_code", context.alias("context"), F.col("doa_judge").alias("judgment"), "status",
        F.array_sort(F.array_compact(F.array(text("service_uid")))).alias("service_orders"), parent.alias("doa_sales_order"), own.alias("sales_order"), relation(parent, own).alias("sales_order_relation"),
        text("e.production_order").alias("production_order"), barcode.alias("barcode"), material.alias("material_sn"), relation(barcode, material).alias("serial_relation"), text("e.model").alias("model"),
        text("e.factory_date").alias("factory_product"), text("e.factory_equipment").alias("factory_equipment"), text("e.warranty_product").alias("warranty_product"), text("e.warranty_equipment").alias("warranty_equipment"),
        company_flag(F.lit(None).cast("string"), F.col("service_uid")).alias("is_company"),
    )


def day_of(value: Column) -> Column:
    """The day of a date, or of a time with or without an offset (the day as it is written); null if there's none."""
    zoned = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(zoned, F.left(value, F.lit(10)).try_cast("date")).otherwise(parse_date(value))


def _settled(candidates: Column, invalid: Column) -> Column:
    status = F.when(F.size(candidates) > 1, "conflict").when(F.size(invalid) > 0, "invalid").when(F.size(candidates) == 0, "missing").otherwise("valid")
    return F.struct(status.alias("status"), F.when(status == "valid", candidates[0]).alias("value"), candidates.alias("candidates"), invalid.alias("invalid"))


def resolved(values: Column, dates: bool) -> Column:
    """(status, value, candidates, invalid) of an array of texts."""
    there = F.filter(F.transform(values, lambda v: text(v)), lambda v: v.isNotNull())
    kept = F.filter(F.transform(there, lambda v: F.date_format(day_of(v), "yyyy-MM-dd")), lambda v: v.isNotNull()) if dates else there
    bad = F.filter(there, lambda v: day_of(v).isNull()) if dates else F.array().cast("array<string>")
    return _settled(F.array_sort(F.array_distinct(kept)), F.array_sort(F.array_distinct(bad)))


def documents(found: DataFrame, wanted: DeviceFilter = DeviceFilter(), part: int = PART) -> DataFrame:
    """(device, basis, part, evidence, and the fields) of each device with at least one matching piece; all its pieces are given.

    One aggregation makes the fields and counts of whole devices, where equal texts are merged before the shuffle; pieces are collected by device and part.
    """
    sources = sorted({c for columns, _ in FIELDS.values() for c in columns})
    whole = found.groupBy("device").agg(F.min("basis").alias("basis"), F.count("*").alias("n_pieces"), F.bool_or(wanted.matches()).alias("hit"), *[F.collect_set(c).alias(c) for c in sources])
    fields = [resolved(F.concat(*[F.col(c) for c in columns]), dates).alias(name) for name, (columns, dates) in FIELDS.items()]
    heads = whole.where("hit").select("device", "basis", "n_pieces", *fields)
    # the pieces of a device beyond ``part`` are dealt out before they are collected
    many = heads.where(F.col("n_pieces") > part).select("device", F.ceil(F.col("n_pieces") / part).cast("int").alias("parts"))
    piece = F.struct(*[c for c in found.columns if c not in ("device", "basis")])
    dealt = found.join(many, "device", "left").select("device", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doa_code"), F.col("parts"))).cast("int").alias("part"), piece.alias("piece"))
    collected = dealt.groupBy("device", "part").agg(F.array_sort(F.collect_list("piece")).alias("evidence"))
    return heads.join(collected, "device").select("device", "basis", "part", "n_pieces", "evidence", *FIELDS)


def page_devices(found: DataFrame, place: str | None = None, size: int = 30, wanted: DeviceFilter = DeviceFilter()) -> list[str]:
    """The next ``size`` devices with a matching piece after ``place`` (none: the first ones), in order."""
    keys = found.where(wanted.matches()) if wanted != DeviceFilter() else found
    keys = keys if place is None else keys.where(F.col("device") > place)
    return [r.device for r in keys.select("device").distinct().orderBy("device").limit(size).collect()]


class _Summary:
    """What the pieces of one device say together, taken in slices that come in the order of ``line``: a digest, and the different values of each column."""

    def __init__(self, device: str, basis: str, columns: list[str]):
        self.device, self.basis, self.n, self.digest = device, basis, 0, hashlib.md5()
        self.values: dict[str, list[pa.Array]] = {c: [] for c in columns}

    def add(self, rows: pa.RecordBatch) -> None:
        self.digest.update((";" * (self.n > 0) + ";".join(rows["line"].to_pylist())).encode())
        self.n += rows.num_rows
        for c, parts in self.values.items():
            parts.append(pc.unique(rows[c].drop_null()))
            if len(parts) > 64:
                parts[:] = [pc.unique(pa.concat_arrays(parts))]

    def row(self) -> list:
        different = [pc.unique(pa.concat_arrays(parts)) for parts in self.values.values()]
        return [self.device, self.basis, self.n, self.digest.hexdigest(), *[values.take(pc.sort_indices(values)) for values in different]]


def _starts(column: pa.Array) -> list[int]:
    """Where each run of equal values begins, and the end."""
    n = len(column)
    moves = pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1))).to_pylist() if n > 1 else []
    return [0, *[i + 1 for i in moves], n]


def summaries(found: DataFrame, line: Column, wanted: DeviceFilter = DeviceFilter()) -> DataFrame:
    """(device, basis, n_pieces, digest, and the fields) of each device with at least one matching piece: one row a device.

    ``digest`` is the MD5 of the texts ``line`` of all its pieces, in order and joined by semicolons. The pieces come sorted, so that a task holds the different values of
    one device at a time and never its pieces.
    """
    sources = sorted({c for columns, _ in FIELDS.values() for c in columns})
    if wanted != DeviceFilter():
        found = found.join(found.where(wanted.matches()).select("device").distinct(), "device", "left_semi")
    kinds = pa.schema([("device", pa.string()), ("basis", pa.string()), ("n_pieces", pa.int64()), ("digest", pa.string()), *[(c, pa.list_(pa.string())) for c in sources]])

    def table(rows: list[list]) -> pa.RecordBatch:
        plain = [pa.array(values, kinds.field(i).type) for i, values in enumerate(list(zip(*rows, strict=True))[:4])]
        lists = [pa.ListArray.from_arrays(pa.array(accumulate((len(v) for v in values), initial=0), pa.int32()), pa.concat_arrays(values)) for values in list(zip(*rows, strict=True))[4:]]
        return pa.RecordBatch.from_arrays([*plain, *lists], schema=kinds)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, done, held = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch["device"])
            for first, end in zip(starts, starts[1:], strict=False):
                rows = batch.slice(first, end - first)
                device = rows["device"][0].as_py()
                if open_one is None or open_one.device != device:
                    if open_one is not None:
                        done.append(open_one.row())
                        held += sum(len(values) for values in done[-1][4:])
                        if held > 50_000 or len(done) >= 1000:
                            yield table(done)
                            done, held = [], 0
                    open_one = _Summary(device, rows["basis"][0].as_py(), sources)
                open_one.add(rows)
        if open_one is not None:
            yield table([*done, open_one.row()])

    dealt = found.select("device", "basis", line.alias("line"), *sources).repartition("device").sortWithinPartitions("device", "line")
    texts = ", ".join(f"{c} array<string>" for c in sources)
    whole = dealt.mapInArrow(summarised, f"device string, basis string, n_pieces bigint, digest string, {texts}")
    no_texts = F.array().cast("array<string>")
    # values that are no days come as they stay: without blanks, different and in order
    fields = [(resolved(F.concat(*[F.col(c) for c in columns]), True) if dates else _settled(F.col(columns[0]), no_texts)).alias(name) for name, (columns, dates) in FIELDS.items()]
    return whole.select("device", "basis", "n_pieces", "digest", *fields)


def document_relations(found: DataFrame) -> DataFrame:
    """(device, relation, n): how many pieces of a device have an order that is the declaration's, another one, or none; and likewise serial numbers."""
    kinds = F.explode(F.array(F.concat(F.lit("sales_order:"), "sales_order_relation"), F.concat(F.lit("serial:"), "serial_relation"))).alias("relation")
    return found.select("device", kinds).groupBy("device", "relation").agg(F.count("*").alias("n"))
