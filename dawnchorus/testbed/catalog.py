"""All check queries."""

from dawnchorus.testbed import (  # noqa: F401
    checks_audio,
    checks_basics,
    checks_clips,
    checks_formats,
    checks_recordings,
    checks_species,
    checks_streams,
)
from dawnchorus.testbed.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
