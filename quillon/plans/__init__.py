"""Registered analyses, composed of sources, functions and operators."""

from quillon.plans import (  # noqa: F401
    controls, families, generators, inference, information, line_effects, models, parsing, relations, resampling, search, streams, transliteration, vectors, vocabulary,
)
