"""Queries of the engine; importing the package registers them."""

from . import registry, texts, frames, large  # noqa: F401, I001  each uses what those before register
