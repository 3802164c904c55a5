"""What is to be extracted, as a list of attributes: compiled to a prompt, to typed columns, and to rules.

Role, dialogue and reply are always there and keep their own reading and rules. Every other attribute has a type and may be
optional; a value of another type is no value when responses are read, and a finding when lines are validated.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoflow.functions.text import strip
from convoflow.operators import extract
from convoflow.sources.jsonl import at, kind

#: An attribute's type: what the prompt calls it, the variants that are of it, and its column.
TYPES = {
    "string": ("string", "^STRING$", "string"),
    "integer": ("integer", "^BIGINT$", "bigint"),
    "number": ("number", "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "double"),
    "boolean": ("boolean", "^BOOLEAN$", "boolean"),
    "strings": ("[string]", "^ARRAY<(STRING|VOID)>$", "array<string>"),
}
#: Names that have a reading of their own, or are keys.
CORE = ("role", "dialogue", "reply")
RESERVED = (*CORE, "doc_id", "chunk_id", "dialogue_index", "line_no", "chunk_text", "items", "item", "at")
#: Other names of types, as they are found in written schemas.
_SAID = {"str": "string", "text": "string", "int": "integer", "long": "integer", "float": "number", "double": "number", "bool": "boolean", "list": "strings", "array": "strings", "[string]": "strings", "list[str]": "strings"}


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    description: str = ""
    optional: bool = False

    def __post_init__(self) -> None:
        if not self.name.isidentifier() or self.name in RESERVED or self.name.startswith("_"):
            raise ValueError(f"{self.name!r} can be no attribute's name")
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r} of {self.name}; known: {', '.join(TYPES)}")

    def fits(self, item: Column) -> Column:
        """Whether the item's value is of the type; an absent or null one fits an optional attribute."""
        value = at(item, f"$.{self.name}")
        absent = value.isNull() | (kind(value) == "VOID")
        return F.coalesce(absent, F.lit(True)) & F.lit(self.optional) | F.coalesce(kind(value).rlike(TYPES[self.type][1]), F.lit(False))

    def column(self, item: Column) -> Column:
        """The value, null where it is not of the type; strings are stripped."""
        value = F.try_variant_get(item, f"$.{self.name}", TYPES[self.type][2])
        value = strip(value) if self.type == "string" else value
        return F.when(F.coalesce(kind(at(item, f"$.{self.name}")).rlike(TYPES[self.type][1]), F.lit(False)), value).alias(self.name)


@dataclass(frozen=True)
class Schema:
    task: str = "Extract the dialogue of the characters."
    attributes: tuple[Attribute, ...] = ()
    example: str | None = None
    described: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [a.name for a in self.attributes]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"attributes named twice: {', '.join(sorted(twice))}")

    @classmethod
    def of(cls, found: Mapping) -> Schema:
        """From a written schema: task_description, attributes (name, type, description; `|null` or optional: true), example."""
        extra, described = [], {}
        for a in found.get("attributes", []):
            said = str(a.get("type", "string")).replace(" ", "").lower()
            named = said.removesuffix("|null")
            if a["name"] in CORE:
                described[a["name"]] = a.get("description", "")
            else:
                extra.append(Attribute(a["name"], _SAID.get(named, named), a.get("description", ""), bool(a.get("optional", said != named))))
        example = found.get("example")
        text = example if isinstance(example, str) or example is None else json.dumps(example, ensure_ascii=False)
        return cls(found.get("task_description", cls.task), tuple(extra), text, described)

    def prompt(self, window: int = 6) -> str:
        """The system prompt: the task, the wanted items with what each attribute is, the reply rules, and an example."""
        said = lambda type_, optional, text: type_ + " | null" * optional + (f"  // {text}" if text else "")
        core = [(name, said(type_, False, self.described.get(name, ""))) for name, type_ in extract.ITEM_KEYS]
        return extract.prompt(self.task, window, (*core, *((a.name, said(TYPES[a.type][0], a.optional, a.description)) for a in self.attributes)), self.example)

    def columns(self, item: Column) -> list[Column]:
        """The attributes of an item (a variant) as typed columns."""
        return [a.column(item) for a in self.attributes]

    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def rule(self, item: Column, otherwise: Column) -> Column:
        """The code of the first attribute, in order, that is missing or of another type: E_ATTRIBUTE and its name."""
        found = otherwise
        for a in reversed(self.attributes):
            found = F.when(~a.fits(item), F.lit(f"E_ATTRIBUTE:{a.name}")).otherwise(found)
        return found


def names(schema: Schema | None) -> Sequence[str]:
    return schema.names() if schema else []
