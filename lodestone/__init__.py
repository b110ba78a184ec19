"""Structural questions about bodies of text files, as Spark jobs."""

from lodestone.operators.more_rules import register
from lodestone.operators.parsers import register_parser
from lodestone.operators.rules import validate
from lodestone.sources.files import scan

__all__ = ["register", "register_parser", "scan", "validate"]
