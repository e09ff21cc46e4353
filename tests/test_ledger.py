"""Commits of context layers against a plain fold over the events of each project."""

import hashlib
import json
import random

from corvane.operators.ledger import EVENT, MOST_ENTRIES, NO_BRIEF, STATE, commit, empty_state

LEVELS = {"public": 0, "internal": 1, "confidential": 2, "secret": 3}


def fp(fields):
    return hashlib.sha1(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def plain(events):
    """events in order; the state of one project."""
    s = {"claims": [], "packets": [], "briefs": [], "triples": [], "layers": {}, "ledger": [], "rejected": []}
    version = 0
    for _, seq, ts, kind, topic, reasoning, papers, tenant, level, claim_id, patch, editor in events:
        if kind == "refresh":
            version += 1
            papers = papers or []
            level = (level or "internal").strip().lower()
            s["claims"], s["packets"] = [], []
            for i, (title, year, source, doi, url, conf) in enumerate(papers, 1):
                c = {"claim_id": f"lit-{ts}-{i}", "type": "paper_recommendation", "title": title or "", "source": source or "", "doi": doi or "", "url": url or "", "topic": topic or "", "access_level": level, "year": None if year is None else str(year), "confidence": "0" if conf is None else str(conf), "tenant_id": tenant}
                s["claims"].append((i, c["claim_id"], c))
                if i <= 8:
                    s["packets"].append((i, c["claim_id"], f"{title or ''} ({year}) [{source or ''}] conf={c['confidence']}", tenant, level))
            names = [p[0] for p in papers[:3] if p[0]]
            s["briefs"] = [(reasoning.strip() if reasoning else "; ".join(names) if names else NO_BRIEF, tenant, level)]
            order, t = sorted(papers, key=lambda p: -(p[5] or 0.0)), []
            for i, p in enumerate(order):
                if p[0]:
                    t.append((p[0], "targets_topic", topic, p[5] or 0.0))
                if p[2]:
                    t.append((p[0] or "", "published_in", p[2], p[5] or 0.0))
                if i + 1 < len(order) and p[0] and order[i + 1][0] and p[1] and order[i + 1][1]:
                    t.append((p[0], "improves_upon" if p[1] >= order[i + 1][1] else "precursor_of", order[i + 1][0], round(((p[5] or 0) + (order[i + 1][5] or 0)) / 2, 4)))
            s["triples"] = [(i, *x, tenant, level) for i, x in enumerate(t[:80], 1)]
            s["layers"] = {k: (version, False) for k in ("L1", "L2", "L3", "KG")}
            s["ledger"].append((version, "task3_context_refresh", ts, topic, None, None, len(papers), max(0, len(papers) - 8), None, None, tenant))
            continue
        target = next((c for _, i, c in s["claims"] if i == claim_id), None)
        own = (target or {}).get("tenant_id") or ""
        if target is None:
            s["rejected"].append((seq, claim_id, "not_found"))
        elif own.strip() and own.strip() != (tenant or "").strip():
            s["rejected"].append((seq, claim_id, "tenant_mismatch"))
        elif LEVELS.get((level or "").strip().lower(), 1) < LEVELS.get((target["access_level"] or "").strip().lower(), 1):
            s["rejected"].append((seq, claim_id, "access_denied"))
        else:
            version += 1
            was = fp(target)
            target.update(patch or {})
            s["layers"] = {k: (version, False) if k == "L1" else (v, True) for k, (v, _) in s["layers"].items()}
            s["ledger"].append((version, "manual_override", ts, None, claim_id, editor or "user", None, None, was, fp(target), tenant))
    s["ledger"] = s["ledger"][-MOST_ENTRIES:]
    return s


def project(state, pid):
    rows = {k: sorted((tuple(r[c] for c in d.columns if c != "pid") for r in d.where(d.pid == pid).collect()), key=repr) for k, d in state.items()}
    rows["layers"] = {k: (v, stale) for k, v, stale in rows["layers"]}
    return rows


def made(seed):
    r = random.Random(seed)
    events = []
    for pid in ("p", "q", "r"):
        last = None
        for seq in range(1, 15):
            ts = 1000 + seq
            if r.random() < 0.3 or seq == 3:
                papers = r.choice([None, [], [(r.choice(["A study", "B work", "", None]) and f"T{i}" or "", r.choice([None, 1999, 2010, 2020]), r.choice(["web", "", None]), "10.1/x", None, r.choice([None, 0.25, 0.5, 0.75])) for i in range(r.randint(1, 12))]])
                papers = papers if seq != 3 else [(f"T{i}", 2000 + i, "web", "", "", 0.5) for i in range(4)]
                last = (ts, len(papers or []))
                events.append((pid, seq, ts, "refresh", f"topic {seq}", r.choice([None, "", " because "]), papers, r.choice([None, "t1"]), r.choice([None, "Internal", "confidential"]), None, None, None))
            else:
                at = f"lit-{last[0]}-{r.randint(1, last[1] + 1)}" if last else "lit-1-1"
                events.append((pid, seq, ts, "override", None, None, None, r.choice([None, "t1", "t2"]), r.choice(["public", "internal", "secret"]), at, r.choice([{"title": f"new {seq}"}, {"note": "x", "tenant_id": "t2"}, {"access_level": "secret"}, {}]), r.choice([None, "me"])))
    return events


def compare(state, events):
    for pid in sorted({e[0] for e in events}):
        want, got = plain([e for e in events if e[0] == pid]), project(state, pid)
        for k in ("claims", "packets", "briefs", "triples", "ledger"):
            assert got[k] == sorted(want[k], key=repr), (pid, k)
        assert got["layers"] == want["layers"], pid


def test_one_commit_equals_a_plain_fold(spark):
    events = made(1)
    got = commit(empty_state(spark), spark.createDataFrame(events, EVENT))
    assert set(got) == {*STATE, "rejected"}
    compare(got, events)
    seen = {r.status for r in got["rejected"].collect()}
    want = {x[2] for pid in "pqr" for x in plain([e for e in events if e[0] == pid])["rejected"]}
    assert seen == want and "not_found" in seen and len(seen) > 1


def test_two_commits_equal_one(spark):
    events = made(2)
    first, second = [e for e in events if e[1] <= 7], [e for e in events if e[1] > 7 and e[0] != "r"]
    state = commit(empty_state(spark), spark.createDataFrame(first, EVENT))
    state = {k: spark.createDataFrame(d.collect(), STATE[k]) for k, d in state.items() if k in STATE}  # as tables written between
    compare(commit(state, spark.createDataFrame(second, EVENT)), first + second)
    same = commit(state, spark.createDataFrame([], EVENT))
    assert all(sorted(map(repr, same[k].collect())) == sorted(map(repr, state[k].collect())) for k in STATE)


def test_the_ledger_keeps_its_last_entries(spark):
    papers = [("T", 2000, "web", "", "", 0.5)]
    events = [("p", 0, 5, "refresh", "t", None, papers, None, None, None, None, None)] + [("p", i, 5, "override", None, None, None, None, "internal", "lit-5-1", {"title": f"n{i}"}, None) for i in range(1, MOST_ENTRIES + 20)]
    state = commit(empty_state(spark), spark.createDataFrame(events, EVENT))
    versions = sorted(r.version for r in state["ledger"].collect())
    assert versions == list(range(21, MOST_ENTRIES + 21))
    assert state["claims"].first().fields["title"] == f"n{MOST_ENTRIES + 19}"
