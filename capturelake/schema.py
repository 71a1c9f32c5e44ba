"""Schemas of the engine's tables: one row per file, request or frame."""

from __future__ import annotations

#: What the header source reads of a file, before anything is resolved.
HEADER = (
    "path string, ok boolean, error string, header_sample_rate bigint, declared_total_samples bigint, "
    "total_samples_known boolean, bits_per_sample int, channels int, min_block int, max_block int, "
    "min_frame int, max_frame int, file_size bigint, audio_offset bigint, tags array<struct<k:string,v:string>>"
)
#: A capture with everything resolved.
PROBE = (
    "path string, ok boolean, error string, warnings array<string>, header_sample_rate bigint, declared_total_samples bigint, "
    "total_samples bigint, total_samples_known boolean, total_samples_wraps int, total_samples_estimated boolean, "
    "total_samples_scanned boolean, total_samples_from_companion boolean, total_samples_from_vorbis boolean, "
    "rate_from_vorbis boolean, bits_per_sample int, channels int, file_size bigint, audio_offset bigint, real_rate_hz double, is_rf boolean"
)
FRAMES = "path string, off bigint, block_size int, hlen int, number bigint, variable boolean"
WAV = "path string, duration_s double"
LOG = "path string, text string"
FILES = "path string, dir string, stem string, ext string, file_size bigint"
