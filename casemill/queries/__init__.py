"""Registered queries: name -> (function of (spark, folder), equivalent SQL or None)."""

from casemill.queries import answers, labels, learning, metrics, pages, retrieval, text

ALL: dict = {}
for _module in (labels, metrics, text, pages, retrieval, learning, answers):
    for _name, _entry in _module.QUERIES.items():
        if _name in ALL:
            raise ValueError(f"query {_name} registered twice")
        ALL[_name] = _entry
