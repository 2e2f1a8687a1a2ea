"""A PySpark-native engine for classifying invoice-like documents at scale."""

from importlib import import_module

_NAMES = {
    "classify": "plans.classify", "learn_from": "plans.classify", "route": "plans.classify", "organize_plan": "plans.organize", "run_incremental": "streaming.incremental",
    "read_progress": "streaming.incremental", "with_fingerprint": "functions.text", "with_entities": "functions.entities", "parse_response": "functions.responses",
    "validate_vat": "functions.validators", "validate_iban": "functions.validators", "match_templates": "operators.templates", "learn": "operators.templates",
    "scan_pdfs": "sources.files", "extract": "sources.files", "classify_batch": "plans.classify", "classify_in_order": "plans.ordered", "Sessions": "plans.sessions",
    "TemplateStore": "sources.template_store", "VersionedTable": "sources.versioned", "move_files_journaled": "sources.moves", "existing_files": "operators.free_names",
    "write_json_document": "sources.files", "likeness_counts": "operators.likeness",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(import_module(f"{__name__}.{_NAMES[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
