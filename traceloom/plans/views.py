"""The views: which columns a dataset is filtered, searched and sorted by."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    """``exact``: filter name to columns. ``orders``: the same for order numbers, with the width of padded ones."""

    name: str
    key: str
    date: str | None
    search: tuple[str, ...]
    sort: tuple[str, ...]
    exact: tuple[tuple[str, tuple[str, ...]], ...] = ()
    orders: tuple[tuple[str, tuple[str, ...], int], ...] = ()
    limit: int = 10_000
    needs_filter: bool = False


#: Column names and limits of the datasets.
REPAIRS = View(
    "repairs", "repair_id", "gstrs_date", ("ERROR_CODE", "ERROR_MSG", "ZGZMS", "RPDESC", "ZMCOD1", "PCODE", "VBELN", "AUFNR"), ("ZDATE_WX", "ZTIME", "repair_id"),
    (("sn", ("PCODE",)), ("part_sn", ("RECORD01REPAIRM",)), ("material", ("MATNR",)), ("station", ("ZNGGZ",)), ("responsibility", ("ZZRFL",)), ("model", ("ZJXMC", "MAKTX", "MATNR"))),
    (("sales_order", ("VBELN",), 10), ("production_order", ("AUFNR",), 12)),
)
ORDERS = View(
    "orders", "order_id", "gstrs_date", ("AUFNR", "VBELN", "NAME1_ZU", "MAKTX_TH", "KID", "GSTRS"), ("gstrs_date", "last_synced_at", "order_id"),
    (("source", ("source",)), ("model", ("MAKTX_TH", "MAKTX")), ("customer", ("KID",)), ("base", ("LGORT", "WERKS"))),
    (("sales_order", ("VBELN",), 10), ("production_order", ("AUFNR",), 12)),
)
STATIONS = View(
    "stations", "HISTROYID", "gstrs_date", ("HISTROYID", "PCODE", "OCODE", "AUFNR", "SPEC", "OPERATION", "GSTRS", "ACTUAL_START_TIME", "ACTUAL_END_TIME"), ("ACTUAL_START_TIME", "HISTROYID", "SPEC_TIME"),
    (("sn", ("PCODE",)), ("model", ("MAKTX_TH",)), ("station", ("PCODE", "LINE_CODE", "SPEC", "OPERATION")), ("base", ("LGORT", "WERKS"))),
    (("production_order", ("AUFNR",), 12), ("sales_order", ("KDAUF",), 10)), limit=100_000,
)
POSTINGS = View(
    "postings", "posting_id", "gstrs_date", ("MBLNR", "MJAHR", "ZEILE", "MATNR", "AUFNR_1", "VBELN_EX", "KUNNR", "NAME1"), ("gstrs_date", "posting_id"),
    (("order_type", ("AUART",)), ("cpx", ("CPX",)), ("model", ("MATNR",)), ("material", ("MATNR",)), ("base", ("LGORT", "WERKS"))),
    (("production_order", ("AUFNR_1",), 12), ("sales_order", ("VBELN_EX",), 10)), needs_filter=True,
)
BINDINGS = View(
    "bindings", "binding_id", None, ("ZCODE_HEAD", "ZCODE_ITEM", "AUFNR_HEAD", "AUFNR_ITEM", "PRODH"), ("ZCODE_HEAD", "ZCODE_ITEM", "AUFNR_HEAD", "AUFNR_ITEM", "binding_id"),
    (("model", ("PRODH",)), ("head_sn", ("ZCODE_HEAD",)), ("item_sn", ("ZCODE_ITEM",))),
    (("production_order", ("AUFNR_HEAD", "AUFNR_ITEM"), 12), ("head_order", ("AUFNR_HEAD",), 12), ("item_order", ("AUFNR_ITEM",), 12)),
)
DECLARATIONS = View(
    "declarations", "doa_code", "declare_date", ("doa_code", "doa_type", "declare_reason", "service_uid", "status", "doa_judge", "customer_uid", "device_sn", "spare_part_sn", "product_name", "review_name", "detail_problem", "problem_conclusion", "declare_uid", "business_unit", "acceptance_uid"), ("declare_time", "doa_code"),
    (("doa_code", ("doa_code",)), ("doa_type", ("doa_type",)), ("status", ("status",)), ("judgment", ("doa_judge",)), ("enrichment_status", ("enrichment_status",)), ("customer", ("customer_uid",)), ("service_order", ("service_uid",)), ("sn", ("device_sn",)), ("model", ("product_name",)), ("sales_order", ("sales_order",))),
    limit=250_000, needs_filter=True,
)
CHANGES = View(
    "changes", "change_id", "create_date", ("so_code", "customer_name", "device_sn", "change_type", "part_number", "part_sn", "part_name", "original_code", "remark", "operator"), ("create_time", "change_id"),
    (("service_order", ("so_code",)), ("customer", ("customer_name",)), ("sn", ("device_sn",)), ("change_type", ("change_type",)), ("part_number", ("part_number",)), ("part_sn", ("part_sn",)), ("operator", ("operator",)), ("need_return", ("need_return",)), ("revoked", ("is_revoked",))),
    limit=250_000, needs_filter=True,
)
VIEWS = {v.name: v for v in (REPAIRS, ORDERS, STATIONS, POSTINGS, BINDINGS, DECLARATIONS, CHANGES)}
