"""Book profiles (YAML), defaults of a run, and proposals for a profile from what was observed."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.render import Policy

#: What a run takes where neither it nor its profile says otherwise.
DEFAULTS = {"expected_pages": 30, "list_pages": [6, 7, 8, 9], "known_bad_terms": [], "expected_strings": [], "wrap_width": 88, "context_window": 0, "short_page_bytes": 0}


def load(path: str) -> dict:
    """A profile file; it must have an id."""
    import yaml

    p = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(p, dict) or not str(p.get("id") or "").strip():
        raise ValueError(f"profile without id: {path}")
    return p


def save(path: str, profile: Mapping) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(dict(profile), sort_keys=False, allow_unicode=True))


def resolved(run: Mapping, profile: Mapping | None = None) -> dict:
    """Settings of a run: its own, then the profile's, then the defaults; the context window is held to 0 to 2."""
    qa = (profile or {}).get("qa") or {}
    out = {k: run[k] if run.get(k) not in (None, 0, [], "") else qa[k] if qa.get(k) not in (None, 0, [], "") else v for k, v in DEFAULTS.items()}
    out["context_window"] = max(0, min(2, int(out["context_window"])))
    return out


def policy(profile: Mapping | None) -> Policy:
    r = (profile or {}).get("rendering") or {}
    return Policy(int(r.get("wrap_width") or 88), r.get("code_language") or "", tuple(r.get("text_cues") or ()), tuple(r.get("table_cues") or ()), bool(r.get("boxed_sets")), bool(r.get("diagram_text")), bool(r.get("footers")))


def type_patch(observed: DataFrame, known: DataFrame) -> DataFrame:
    """(book_id, page, known, inferred) of pages whose inferred type isn't the known one; of several the last observed counts.

    observed is (book_id, page, inferred, seq), known is (book_id, page, known).
    """
    o = observed.where("inferred IS NOT NULL AND inferred <> ''").groupBy("book_id", "page").agg(F.max_by("inferred", F.struct("seq", "inferred")).alias("inferred"))
    return o.join(known.select("book_id", "page", "known"), ["book_id", "page"], "left").where(~F.col("inferred").eqNullSafe(F.col("known"))).select("book_id", "page", "known", "inferred")


def figure_count_patch(found: int, known: int) -> dict:
    """The number of figures to propose: what was found, if some were and their number is another."""
    return {"expected_figure_count": found} if found > 0 and found != known else {}
