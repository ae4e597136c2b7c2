"""Helpers of these tests under a name that no other conftest has."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("conftest.py"))
_m = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_m)
words, lower_ascii, crc_fold = _m.words, _m.lower_ascii, _m.crc_fold
