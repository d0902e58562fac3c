"""A truth table of the judge: small trees over one small mission, each with the verdict that its rules give.

The expected columns are written by hand from the rules and never computed; they are what the query's
SQL returns. Two robots, three places in a line (a, b, c), a charging station at c, one light item at a.
"""

from __future__ import annotations

import json

MISSION = {
    "robots": ["alpha", "beta"], "items": ["kit", "slab"], "connected": [["a", "b"], ["b", "c"]], "charge_stations": ["c"],
    "can_reach": [[r, p] for r in ("alpha", "beta") for p in "abc"], "goal": [["at", "alpha", "b"]], "faults": [], "skill_aliases": {},
    "init_dynamic": [
        ["at", "alpha", "a"], ["free", "alpha"], ["mobile", "alpha"], ["at", "beta", "a"], ["free", "beta"], ["mobile", "beta"],
        ["item_at", "kit", "a"], ["light", "kit"], ["item_at", "slab", "a"], ["heavy", "slab"],
    ],
}
AB, BC, AC = (f'<MoveTo robot="alpha" from="{x}" to="{y}"/>' for x, y in ("ab", "bc", "ac"))
AT_A, AT_B = (f'<IsAtLocation robot="alpha" location="{x}"/>' for x in "ab")
PICK = '<PickUp robot="alpha" item="kit" location="a"/>'
GIVE, TAKE = (f'<Handover{x} giver="alpha" receiver="beta" item="kit" location="a"/>' for x in ("Give", "Take"))
CLEAR = '<ClearPath robot="alpha" edge_from="a" edge_to="b"/>'
LIFT = '<CoPickUp robot1="alpha" robot2="beta" item="slab" location="a"/>'
CARRY = '<CoMoveTo robot1="alpha" robot2="beta" item="slab" from="a" to="b"/>'
READY, WAIT = '<SignalReady robot="alpha" item="kit" to="beta"/>', '<WaitReady robot="beta" item="kit" from="alpha"/>'
BLOCKED = {"faults": [{"type": "blocked_edge", "edge": ["b", "a"]}]}
FUMBLE = {"faults": [{"type": "handover_fail", "giver": "alpha", "receiver": "beta", "item": "kit", "times": 1}], "goal": [["carrying", "beta", "kit"]]}
TIRED = {"faults": [{"type": "battery", "robot": "alpha", "budget": 1}], "goal": [["at", "alpha", "c"]]}
HAS = {"goal": [["carrying", "beta", "kit"]]}
SLAB = {"goal": [["at", "beta", "b"]]}


def both(x: str, y: str) -> str:
    return f"<Parallel><Sequence>{x}</Sequence><Sequence>{y}</Sequence></Parallel>"


# case: body of the main tree, changes of the mission, attributes of the root; success, reason, recoveries, error type
CASES: dict[str, tuple[str, dict, str, bool, str, int, str | None]] = {
    "X1 goal": (AB, {}, "", True, "goal_reached", 0, None),
    "X1 goal missing": (AT_A, {}, "", False, "tree_done_goal_missing", 0, "goal_segment_missing"),
    "X1 failed": (AT_B, {}, "", False, "tree_failed", 0, "condition_guard_failed"),
    "X2 unknown tag": ("<Fly/>", {}, "", False, "error: unknown node tag 'Fly'", 0, "hallucinated_node"),
    "X2 missing attribute": ('<MoveTo robot="alpha" to="b"/>', {}, "", False, "error: action 'MoveTo' missing attr 'from'", 0, "missing_attr"),
    "X2 missing subtree": ('<SubTree ID="x"/>', {}, "", False, "error: SubTree 'x' not defined", 0, "structural_tree"),
    "X2 empty tree": ("", {}, "", False, "error: empty <BehaviorTree>", 0, "structural_tree"),
    "X3 endless wait": ('<WaitReady robot="alpha" item="kit" from="beta"/>', {}, "", False, "cycle_limit", 0, "deadlock"),
    "X4 sequence": (f"<Sequence>{AT_A}{AB}{AT_B}</Sequence>", {}, "", True, "goal_reached", 0, None),
    "X4 sequence stops": (f"<Sequence>{AT_B}{AB}</Sequence>", {}, "", False, "tree_failed", 0, "condition_guard_failed"),
    "X4 fallback": (f"<Fallback>{AT_B}{AB}</Fallback>", {}, "", True, "goal_reached", 0, None),
    "X4 empty sequence": ("<Sequence/>", {}, "", False, "tree_done_goal_missing", 0, "goal_segment_missing"),
    "X4 empty fallback": ("<Fallback/>", {}, "", False, "tree_failed", 0, "other"),
    "X5 reactive sequence": (f"<ReactiveSequence>{AT_A}{AB}</ReactiveSequence>", {}, "", True, "goal_reached", 0, None),
    "X5 reactive fallback": (f"<ReactiveFallback>{AT_B}{AB}</ReactiveFallback>", {}, "", True, "goal_reached", 0, None),
    "X6 parallel": (f"<Parallel>{AT_A}{AB}</Parallel>", {}, "", True, "goal_reached", 0, None),
    "X6 one is enough": (f'<Parallel success_threshold="1">{AT_B}{AB}</Parallel>', {}, "", True, "goal_reached", 0, None),
    "X6 one is too many": (f'<Parallel failure_threshold="1">{AT_B}{AB}</Parallel>', {}, "", False, "tree_failed", 0, "condition_guard_failed"),
    "X7 limit": (f'<RetryUntilSuccessful num_attempts="3">{AT_B}</RetryUntilSuccessful>', {}, "", False, "tree_failed", 0, "condition_guard_failed"),
    "X7 no limit": (f"<RetryUntilSuccessful>{AT_B}</RetryUntilSuccessful>", {}, "", False, "cycle_limit", 0, "deadlock"),
    "X9 condition": (f"<Sequence>{PICK}<IsCarrying robot=\"alpha\" item=\"kit\"/>{AB}</Sequence>", {}, "", True, "goal_reached", 0, None),
    "X10 static fact": (f'<Sequence><CheckFact predicate="connected" args="a,b"/>{AB}</Sequence>', {}, "", True, "goal_reached", 0, None),
    "X10 no such fact": ('<CheckFact predicate="connected" args="a,c"/>', {}, "", False, "tree_failed", 0, "other"),
    "X11 alias": ('<GoTo robot="alpha" from="a" to="b"/>', {"skill_aliases": {"GoTo": "MoveTo"}}, "", True, "goal_reached", 0, None),
    "X12 no such edge": (AC, {}, "", False, "tree_failed", 0, "missing_intermediate_leg"),
    "X13 blocked": (AB, BLOCKED, "", False, "tree_failed", 0, "fault_recovery_missing"),
    "X14 cleared": (f"<Fallback>{AB}<Sequence>{CLEAR}{AB}</Sequence></Fallback>", BLOCKED, "", True, "goal_reached", 1, None),
    "X15 battery": (f"<Sequence>{AB}{BC}</Sequence>", TIRED, "", False, "tree_failed", 0, "battery_recovery_missing"),
    "X15 creeps to the station": (f"<Sequence>{AB}<Fallback>{BC}{BC}</Fallback></Sequence>", TIRED, "", True, "goal_reached", 0, None),
    "X15 recharged": (f'<Sequence>{AB}<Fallback>{BC}{BC}</Fallback><Recharge robot="alpha" station="c"/></Sequence>', TIRED, "", True, "goal_reached", 1, None),
    "X16 handover": (both(PICK + GIVE, f'<IsItemAt item="slab" location="a"/>{TAKE}'), HAS, "", True, "goal_reached", 0, None),
    "X16 one side only": (f"<Sequence>{PICK}{GIVE}</Sequence>", HAS, "", False, "cycle_limit", 0, "deadlock"),
    "X16 lifted together": (both(LIFT + CARRY, LIFT + CARRY), SLAB, "", True, "goal_reached", 0, None),
    "X17 fumble": (both(PICK + GIVE, TAKE), FUMBLE, "", False, "tree_failed", 0, "handover_miscoord"),
    "X17 second try": (both(f"{PICK}<Fallback>{GIVE}{GIVE}</Fallback>", f"<Fallback>{TAKE}{TAKE}</Fallback>"), FUMBLE, "", True, "goal_reached", 0, None),
    "X18 signal": (both(READY + AB, WAIT), {}, "", True, "goal_reached", 0, None),
    "X20 stall": ('<WaitReady robot="alpha" item="kit" from="beta"/>', {}, 'mrbtp_bridge="faithful_v1"', False, "stalled_no_progress", 0, "other"),
    "X21 blocked both ways": (f"<Sequence>{CLEAR}{AB}<MoveTo robot=\"alpha\" from=\"b\" to=\"a\"/>{AB}</Sequence>", BLOCKED, "", True, "goal_reached", 1, None),
}


def rows() -> list[tuple[str, str, str]]:
    """(case, meta as JSON, xml)"""
    whole = '<root BTCPP_format="4" {}><BehaviorTree ID="MainTree">{}</BehaviorTree></root>'
    return [(name, json.dumps(MISSION | change), whole.format(root, body)) for name, (body, change, root, *_) in CASES.items()]


def verdict_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {str(ok).lower()}, {quoted(reason)}, {n}::bigint)" for name, (_, _, _, ok, reason, n, _) in CASES.items())
    return f'select * from (values {values}) v("case", success, reason, recoveries)'


def error_sql() -> str:
    quoted = lambda x: "null" if x is None else "'" + x + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(kind)})" for name, (*_, kind) in CASES.items())
    return f'select "case", error_type::varchar as error_type from (values {values}) v("case", error_type)'
