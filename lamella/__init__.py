"""Analytics on nested records with Spark: schemas, skeleton queries, views, validated writes."""

from .plans.project import ALL, MissingField
from .schema import Col, Map, Req, Set, Tag, depict, parse, read_text, unparse
from .sources.reader import FilesReader, Reader, View
from .sources.writer import rejects, validate, write
from .types import CustomType, Types

__all__ = ["ALL", "Col", "CustomType", "FilesReader", "Map", "MissingField", "Reader", "Req", "Set", "Tag", "Types", "View", "depict", "parse", "read_text", "rejects", "unparse", "validate", "write"]
