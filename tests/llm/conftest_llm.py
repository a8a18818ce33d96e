"""Helpers of the tests in this folder."""

import importlib.util
import pathlib

_spec = importlib.util.spec_from_file_location("llm_conftest", pathlib.Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
pairs, in_order, prose, odd_texts, DOC_SCHEMA = _module.pairs, _module.in_order, _module.prose, _module.odd_texts, _module.DOC_SCHEMA
