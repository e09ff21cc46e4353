"""The status cascade against a plain one, over all branches."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from corvane.operators.status import DEGRADED, FLAGS, corrections, paper_status

NOW = dt.datetime(2024, 5, 1, 12)
READY = {"task_5b_reflow", "task_5interpret", "heuristic_fallback"}
ARTIFACT = "pid string, paper_id string, " + ", ".join(f"{f} boolean" for f in FLAGS)


def summary(raw):
    if raw is None:
        return False, None
    try:
        data = json.loads(raw)
    except ValueError:
        return False, "parse_error"
    low, obj = raw.lower(), data if isinstance(data, dict) else {}
    mode = str(obj.get("mode") or "").strip().lower()
    if mode in DEGRADED or mode == "error_fallback" and obj.get("abstract_zh"):
        return True, "degraded_summary"
    if mode == "error_fallback":
        return False, "general_error"
    if any(x in low for x in ("429", "quota", "resource_exhausted")):
        return False, "quota_error"
    if "error" in obj and not obj.get("abstract_zh") or "failed" in low:
        return False, "general_error"
    return True, None


def plain(flags, raw, reflow, row, locked):
    f = dict(zip(FLAGS, (bool(x) for x in flags)))
    has, error = summary(raw)
    hard = error in ("quota_error", "general_error", "parse_error")
    title, status, updated = row or (None, None, None)
    db = (status or "").lower()
    mode, n = "", 0
    if reflow:
        n, mode, note = reflow[0] or 0, (reflow[1] or "").strip().lower(), (reflow[2] or "").strip().lower()
        mode = mode or ("task_5interpret" if note.startswith("used=task_5interpret") else "task_5b_reflow" if "used=task_5b_reflow" in note else "")
    ready = f["has_trans"] and n > 0 and mode in READY
    issue = None
    if f["has_trans"] and not ready:
        issue = "flowb_reflow_missing" if not reflow else "flowb_reflow_empty" if n <= 0 else f"flowb_reflow_{mode}" if mode else "flowb_reflow_unknown_mode"
    busy = db in ("processing_b", "translating_local", "judging_llm")
    stale = lambda s: updated is None or (NOW - updated).total_seconds() >= s
    active = locked is not None and (NOW - locked).total_seconds() <= 3600
    step = "done" if has else "processing" if db in ("t5_queued", "t5_running") else "error" if hard else "processing" if f["has_fixed"] else "pending"
    if ready:
        state = "ready_B"
    elif f["has_trans"] and busy:
        state = "processing_B"
    elif db in ("ready_b", "bilingual_ready"):
        state, error = "need_retry", error or issue or "flowb_artifact_missing"
    elif busy:
        state, error = ("need_retry", error or "stale_flowb") if stale(7500) else ("processing_B", error)
    elif db in ("t5_queued", "t5_running"):
        state = "gold_ready" if has else db
    elif db == "gold_ready":
        state = "gold_ready" if has else "need_retry"
    elif db == "analyzing" and has or db in ("ready_a", "rules_ready", "ocr_ready"):
        state = "gold_ready"
    elif db == "failed":
        state = "need_retry"
    elif db == "analyzing":
        state, error = ("need_retry", error or "stale_analyzing") if stale(600) and not active else ("analyzing", error)
    elif db == "pending":
        state = "pending"
    else:
        state = "gold_ready" if has else "need_retry" if hard else "analyzing" if f["has_fixed"] or f["has_raw"] else "pending"
    if state in ("t5_queued", "t5_running") and step != "done":
        step = "processing"
    if state == "need_retry" and step != "done":
        step, error = "error", error or "missing_summary"
    flow = state if state in ("ready_B", "processing_B") else {"gold_ready": "ready_A", "need_retry": "failed", "pending": "pending"}.get(state, "processing_A")
    a, b = flow == "processing_A", flow == "processing_B"
    stage = lambda ok, going: "done" if ok else "processing" if going else "pending"
    s = [stage(f["has_origin"], False), stage(f["has_stack_a"], a and f["has_origin"]), stage(f["has_stack_b"], a and f["has_origin"]), stage(f["has_raw"], a and (f["has_stack_a"] or f["has_stack_b"])), stage(title not in (None, "", "x", "x.pdf"), a and f["has_raw"])]
    s += [stage(f["has_guide"], a and f["has_raw"]), stage(f["has_fixed"], a and f["has_raw"]), stage(f["has_fusion"], a and f["has_fixed"]), "done" if has else "error" if hard else stage(False, a and f["has_fixed"]), stage(f["has_nllb"] or f["has_trans"], b), stage(f["has_judge"] or f["has_trans"], b), "done" if ready else "error" if f["has_trans"] and not b else stage(False, b)]
    return (state, flow, error, "done" if f["has_raw"] else "pending", "done" if f["has_fixed"] else "processing" if f["has_raw"] else "pending", step, *s, ready and busy)


def test_every_branch(spark):
    r = random.Random(6)
    states = [None, "", "pending", "analyzing", "t5_queued", "t5_running", "gold_ready", "FAILED", "processing_b", "translating_local", "judging_llm", "ready_B", "bilingual_ready", "ready_a", "odd"]
    raws = [None, None, '{"mode": "ok", "abstract_zh": "x"}', '{"mode": " Degraded "}', '{"mode": "error_fallback"}', '{"mode": "error_fallback", "abstract_zh": "y"}', '{"note": "Quota"}', '{"error": "e"}', '{"error": "e", "abstract_zh": "z"}', '{"x": "FAILED"}', "{broken", "[1, 2]", '["failed"]']
    cases = []
    for i in range(2500):
        flags = [r.choice([True, True, False, None]) for _ in FLAGS]
        flags[-1] = r.random() < 0.4
        reflow = r.choice([None, (r.choice([0, 1, 5, None]), r.choice([None, "task_5b_reflow", " Task_5Interpret", "heuristic_fallback", "other"]), r.choice([None, "used=task_5interpret ok", "x used=task_5b_reflow"]))])
        row = r.choice([None, (r.choice([None, "", "x", "x.pdf", "A title"]), r.choice(states), r.choice([None, NOW - dt.timedelta(seconds=r.choice([10, 599, 600, 7499, 7500]))]))])
        cases.append((f"p{i}", flags, r.choice(raws), reflow, row, r.choice([None, NOW - dt.timedelta(seconds=r.choice([5, 3600, 3601]))])))
    many = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = paper_status(
        many([(p, "x", *f) for p, f, *_ in cases], ARTIFACT), many([(p, "x", raw) for p, _, raw, *_ in cases if raw is not None], "pid string, paper_id string, raw string"),
        many([(p, "x", *rf) for p, _, _, rf, *_ in cases if rf], "pid string, paper_id string, sections int, mode string, note string"), many([(p, "x", *row) for p, *_, row, _ in cases if row], "pid string, paper_id string, title string, status string, updated_at timestamp"),
        many([(p, at) for p, *_, at in cases if at], "pid string, locked_at timestamp"), F.lit(NOW))
    rows = {x.pid: tuple(x)[2:] for x in got.collect()}
    assert len(rows) == len(cases)
    wrong = [(c, rows[c[0]], plain(*c[1:])) for c in cases if rows[c[0]] != plain(*c[1:])]
    assert wrong == []
    assert {x[0] for x in rows.values()} == {"ready_B", "processing_B", "need_retry", "gold_ready", "t5_queued", "t5_running", "analyzing", "pending"}
    assert {"stale_flowb", "stale_analyzing", "missing_summary", "flowb_artifact_missing", "flowb_reflow_missing", "flowb_reflow_empty", "flowb_reflow_other", "degraded_summary", "quota_error", "general_error", "parse_error"} <= {x[2] for x in rows.values()}
    healed = corrections(got)
    assert {x.pid for x in healed.collect()} == {p for p, x in rows.items() if x[-1]} != set()
