"""The prompt asks for everything that the contract holds."""

import re

from foliomill.schemas import BIBLIO, EVIDENCE, MATERIAL, RECORD
from foliomill.sources.prompts import PLACEHOLDER, contract, load_prompts


def paths(fields, above=()):
    for field in fields:
        yield (*above, field.name), field
        yield from paths(field.of, (*above, field.name))


def asked():
    """The paths that the contract's lines spell by their indentation, with the line."""
    at, found = [], {}
    for line in contract().splitlines():
        indent, name, rest = re.fullmatch(r"( *)- (\w+): (.*)", line).groups()
        at[len(indent) // 2 :] = [name]
        found[tuple(at)] = rest
    return found


def test_every_field_is_asked_for():
    found, wanted = asked(), dict(paths(RECORD))
    assert list(found) == list(wanted)
    assert len([p for p in found if p[-1] == "source_text"]) == sum(f.of == EVIDENCE for f in wanted.values())
    assert ("materials", "evidence", "page_numbers") in found and len(MATERIAL) + len(BIBLIO) > 20


def test_roles_bounds_and_defaults_are_named():
    found = asked()
    for path, field in paths(RECORD):
        line = found[path]
        assert all(choice in line for choice in field.choices), path
        assert field.low is None or f"from {field.low:g} to {field.high:g}" in line, path
        assert ("required" in line) == field.required, path
        assert field.default is None or f"{str(field.default).lower() if field.default is False else field.default} if not given" in line, path


def test_the_text_has_one_place():
    system, template = load_prompts()
    assert template.count(PLACEHOLDER) == 1 and template.index(PLACEHOLDER) > template.index("- fields_needing_review")
    assert "JSON" in system
