"""Column functions. Each ``f(...)`` raises on invalid input; ``try_f(...)`` gives null instead.

A null item gives null. Functions marked as native are built from Spark's own expressions; the others are Arrow
functions that take a batch of rows at a time, because Spark has no Unicode normalisation, BLAKE3, XXH32 or canonical
JSON. Strings go to Python as Arrow columns, results come back as structs of one call.
"""

from prismark.functions.codec import (
    base64_url, compose, decode, decode_header, decompose, encode_component, encode_header, length_bits, length_field, read_base32, read_units_field, read_varnibble, to_base32, try_compose, try_decode, try_decompose, units_field,
    varnibble,
)
from prismark.functions.codes import (
    audio_code, cdc_chunks, data_code, dct, frame_buffer_code, image_code, instance_code, json_data_url, meta_code, minhash_256, mixed_code, multihash, simhash, stream_bytes, sum_code, text_code, text_features, try_audio_code, try_data_url_bytes,
    try_image_code, try_json_data_url, try_meta_code, try_mixed_code, try_video_code, video_code, video_digest, wta_hash, xxh32,
)
from prismark.functions.text import sliding_window, sliding_window_bytes, text_clean, text_collapse, text_remove_newlines, text_trim

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("codec", "codes", "text", "arrow")]
