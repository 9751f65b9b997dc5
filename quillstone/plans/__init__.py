"""Queries of the engine; importing this package registers them all."""

from quillstone.plans import answers, checking, evaluation, examining, intake, library, more, scoping, search, texts  # noqa: F401
