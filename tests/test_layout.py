"""The subpackage llm stands alone: nothing else imports it."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for path in (ROOT / "sitegrid").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_no_local_checkpoints_or_cross_joins():
    for path in (ROOT / "sitegrid").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", path.read_text()), path
