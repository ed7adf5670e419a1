"""contentmark - main-content labelling of web pages as Spark jobs.

Entry points (see README for the full operator list)::

    from contentmark import shred, nodes, texts, tokens, page_text
    from contentmark import label_block_by_text, label_corpus, extract_blocks
    from contentmark import BlockLabeler, BlockLabelerModel, label_pages
"""

__version__ = "0.1.0"

_EXPORTS = {
    "shred": "contentmark.operators.shred",
    "nodes": "contentmark.operators.shred",
    "texts": "contentmark.operators.shred",
    "tokens": "contentmark.operators.shred",
    "page_text": "contentmark.operators.shred",
    "render": "contentmark.operators.render",
    "label_by_class": "contentmark.plans.labelers",
    "label_by_attr": "contentmark.plans.labelers",
    "label_block_by_attr": "contentmark.plans.labelers",
    "label_by_text": "contentmark.plans.labelers",
    "label_block_by_text": "contentmark.plans.labelers",
    "label_corpus": "contentmark.plans.labelers",
    "extract_blocks": "contentmark.operators.blocks",
    "BlockLabeler": "contentmark.plans.labeller",
    "BlockLabelerModel": "contentmark.plans.labeller",
    "BlockEvaluator": "contentmark.plans.labeller",
    "label_pages": "contentmark.operators.writeback",
    "gold_lines": "contentmark.sources.gold",
    "read_gold_files": "contentmark.sources.gold",
    "read_pages": "contentmark.sources.pages",
    "read_blocks": "contentmark.sources.blocks_io",
    "write_blocks": "contentmark.sources.blocks_io",
    "scratch": "contentmark.session",
    "metrics": "contentmark.operators.evaluate",
    "report": "contentmark.operators.evaluate",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
