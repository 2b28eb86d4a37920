"""Scalar functions over columns: coercions, base conversions, integer coding."""

from ..types import (
    bit_width,
    bytes_to_uuid,
    coerce,
    instant_to_millis,
    millis_to_instant,
    un_zig_zag,
    uuid_to_bytes,
    varint_size,
    zig_zag,
)

__all__ = ["bit_width", "bytes_to_uuid", "coerce", "instant_to_millis", "millis_to_instant", "un_zig_zag", "uuid_to_bytes", "varint_size", "zig_zag"]
