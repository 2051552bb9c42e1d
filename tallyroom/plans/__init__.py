"""Plan shapes shared by the operators."""

from tallyroom.plans.activity import activity_words, active_on, first_index
from tallyroom.plans.devices import device_bucket, of_device
from tallyroom.plans.flags import device_flags
from tallyroom.plans.latest import latest_per_key
from tallyroom.plans.paging import DEEP, Page, beyond, from_offset, order_by, paged, row_at, top_k
from tallyroom.plans.rollup import device_rollup, device_totals
from tallyroom.plans.rows import join_single_rows, single_row_to_rows
from tallyroom.plans.sizing import fits

__all__ = [
    "DEEP", "Page", "active_on", "activity_words", "device_bucket", "device_flags", "device_rollup", "device_totals",
    "beyond", "first_index", "from_offset", "fits", "join_single_rows", "latest_per_key", "of_device", "order_by", "paged", "row_at",
    "single_row_to_rows", "top_k",
]
