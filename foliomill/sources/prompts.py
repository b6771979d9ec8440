"""The instructions sent along with every text chunk, written from the contract that answers must meet."""

from __future__ import annotations

from foliomill.schemas import RECORD, Field

PLACEHOLDER = "{paper_text}"

SYSTEM = (
    "You read experimental research papers and return their data as one JSON object. "
    "Report only what the text states; use null for anything it does not state and list doubtful "
    "fields under fields_needing_review. Keep units as written. Quote the sentence each number "
    "comes from as evidence and mark values you deduced with is_inferred=true. Mark settings the "
    "authors chose as input, measured outcomes as output and everything else as contextual. "
    "Give an impact factor only if the text gives one. Return JSON and nothing else."
)

# What a field of each kind is called in the instructions.
KINDS = {
    "str": "text",
    "num": "number",
    "int": "whole number",
    "bool": "true or false",
    "strs": "list of texts",
    "ints": "list of whole numbers",
    "map": "object of named entries",
    "object": "object with",
    "list": "list of objects, each with",
}
# What the contract itself leaves open: the entries of the three maps, and what some fields are for.
HINTS = {
    "summary": "three to five sentences: what was made or measured, under which conditions, and the main result",
    "input_variables": "a name to its value, unit and role input",
    "output_variables": "a name to its value, unit and role output",
    "contextual_notes": "a name to its value and role contextual",
    "main_findings": "close to the authors' words",
    "relevant_for_optimization": "whether settings are tied to measured numbers",
    "fields_needing_review": "names of fields that are doubtful",
}


def _bounds(field: Field) -> str:
    if field.low is None and field.high is None:
        return ""
    return f"from {field.low:g} to {field.high:g}"


def describe(field: Field, depth: int = 0) -> list[str]:
    """The lines that ask for a field and all that is in it."""
    notes = [
        KINDS[field.kind] if not field.choices else "one of " + ", ".join(field.choices),
        _bounds(field),
        "required" if field.required else "",
        f"{str(field.default).lower() if isinstance(field.default, bool) else field.default} if not given" if field.default is not None else "",
        "or null" if field.nullable and field.kind not in ("object",) else "",
    ]
    text = ", ".join(note for note in notes if note)
    if field.name in HINTS:
        text += f" ({HINTS[field.name]})"
    lines = [f"{'  ' * depth}- {field.name}: {text}{':' if field.of else ''}"]
    for inner in field.of:
        lines += describe(inner, depth + 1)
    return lines


def contract(fields: tuple[Field, ...] = RECORD) -> str:
    return "\n".join(line for field in fields for line in describe(field))


USER_TEMPLATE = (
    "Fill one JSON object with these fields from the text below.\n\n"
    + contract()
    + "\n\n--- text ---\n"
    + PLACEHOLDER
    + "\n--- end of text ---\n\nAnswer with the JSON object alone.\n"
)


def load_prompts() -> tuple[str, str]:
    """System text and user template."""
    return SYSTEM, USER_TEMPLATE
