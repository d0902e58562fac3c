import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import missions, trees
from corvane.plans.compiler import compile_tree
from corvane.plans.judge import judge
from corvane.plans.world import DOMAINS, plan, replay, sample_mission, world_of

META = {
    "robots": ["alpha", "beta"], "items": ["kit"], "connected": [["a", "b"], ["b", "c"]], "charge_stations": ["c"],
    "can_reach": [[r, p] for r in ("alpha", "beta") for p in "abc"], "goal": [["item_at", "kit", "c"]], "faults": [],
    "init_dynamic": [["at", "alpha", "a"], ["free", "alpha"], ["mobile", "alpha"], ["at", "beta", "b"], ["free", "beta"], ["mobile", "beta"], ["item_at", "kit", "a"], ["light", "kit"]],
}


def tree(body, attrs="", extra=""):
    return f'<root BTCPP_format="4" {attrs}><BehaviorTree ID="MainTree">{body}</BehaviorTree>{extra}</root>'


def run(body, faults=(), goal=None, extra="", attrs="", **meta):
    m = META | {"faults": list(faults)} | meta
    if goal is not None:
        m = m | {"goal": goal}
    return judge(m, tree(body, attrs, extra))


MOVE = '<MoveTo robot="alpha" from="a" to="b"/>'
AT_A, AT_B = '<IsAtLocation robot="alpha" location="a"/>', '<IsAtLocation robot="alpha" location="b"/>'
THERE = [["at", "alpha", "b"]]


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        (MOVE, "goal_reached"),
        (AT_A, "tree_done_goal_missing"),
        (AT_B, "tree_failed"),
        (f"<Sequence>{AT_A}{MOVE}{AT_B}</Sequence>", "goal_reached"),
        (f"<Fallback>{AT_B}{MOVE}</Fallback>", "goal_reached"),
        ("<Sequence/>", "tree_done_goal_missing"),
        ("<Fallback/>", "tree_failed"),
        (f"<ReactiveSequence>{AT_A}{MOVE}</ReactiveSequence>", "goal_reached"),
        (f"<ReactiveFallback>{AT_B}{MOVE}</ReactiveFallback>", "goal_reached"),
        (f"<Parallel>{AT_A}{MOVE}</Parallel>", "goal_reached"),
        (f'<Parallel success_threshold="1">{AT_B}{MOVE}</Parallel>', "goal_reached"),
        (f'<Parallel failure_threshold="1">{AT_B}{MOVE}</Parallel>', "tree_failed"),
        (f'<Parallel success_threshold="0">{AT_B}</Parallel>', "tree_done_goal_missing"),
        (f'<RetryUntilSuccessful num_attempts="3">{AT_B}</RetryUntilSuccessful>', "tree_failed"),
        (f"<RetryUntilSuccessful>{AT_B}</RetryUntilSuccessful>", "cycle_limit"),
        ('<CheckFact predicate="connected" args="a,b"/>', "tree_done_goal_missing"),
        ('<CheckFact predicate="connected" args="a,c"/>', "tree_failed"),
        ('<MoveTo robot="alpha" from="a" to="c"/>', "tree_failed"),
        ('<WaitReady robot="alpha" item="kit" from="beta"/>', "cycle_limit"),
        ("<Fly/>", "error: unknown node tag 'Fly'"),
        ('<MoveTo robot="alpha" to="b"/>', "error: action 'MoveTo' missing attr 'from'"),
        ('<CoPickUp robot1="alpha"/>', "error: joint action 'CoPickUp' missing attr 'robot2'"),
        ('<SubTree ID="x"/>', "error: SubTree 'x' not defined"),
        ("", "error: empty <BehaviorTree>"),
        ("<CheckFact/>", "error: CheckFact missing predicate"),
        ('<RetryUntilSuccessful num_attempts="x"><Fallback/></RetryUntilSuccessful>', "error: invalid RetryUntilSuccessful num_attempts 'x'"),
        ("<RetryUntilSuccessful/>", "error: RetryUntilSuccessful requires one child"),
    ],
)
def test_truth_table(body, reason):
    got = run(body, goal=THERE)
    assert got["reason"] == reason and got["success"] == (reason == "goal_reached")


def test_parse_errors():
    assert judge(META, "no tree")["reason"].startswith("error: XML parse error: no <root")
    assert judge(META, "<root><BehaviorTree></root>")["reason"].startswith("error: XML parse error")
    assert judge(META, '<root main_tree_to_execute="M"></root>') == {"success": False, "reason": "error: main tree 'M' not found", "ticks": 0, "recoveries": 0}
    assert judge(META, "text " + tree(MOVE) + " more")["reason"] == "tree_done_goal_missing"


BLOCKED = {"type": "blocked_edge", "edge": ["b", "a"]}
CLEAR = '<ClearPath robot="alpha" edge_from="a" edge_to="b"/>'


def test_blocked_edge():
    assert run(MOVE, [BLOCKED], THERE)["reason"] == "tree_failed"
    got = run(f"<Fallback>{MOVE}<Sequence>{CLEAR}{MOVE}</Sequence></Fallback>", [BLOCKED], THERE)
    assert got["success"] and got["recoveries"] == 1


def test_battery_limps_to_the_station():
    low = {"type": "battery", "robot": "alpha", "budget": 0}
    assert run(MOVE, [low], THERE)["reason"] == "tree_failed"
    rest = '<MoveTo robot="alpha" from="b" to="c"/><Recharge robot="alpha" station="c"/>'
    got = run(f"<Fallback>{MOVE}<Sequence>{MOVE}{rest}</Sequence></Fallback>", [low], [["at", "alpha", "c"]])
    assert got["success"] and got["recoveries"] == 1
    back = '<MoveTo robot="alpha" from="b" to="a"/>'
    assert run(f"<Sequence>{MOVE}<Fallback>{back}{back}</Fallback></Sequence>", [low | {"budget": 1}], THERE)["reason"] == "tree_failed"


def halves(times=1):
    give = '<HandoverGive giver="alpha" receiver="beta" item="kit" location="b"/>'
    take = '<HandoverTake giver="alpha" receiver="beta" item="kit" location="b"/>'
    twice = lambda x: f"<Fallback>{x * times}</Fallback>"
    signal, wait = '<SignalReady robot="alpha" item="kit" to="beta"/>', '<WaitReady robot="beta" item="kit" from="alpha"/>'
    pick = '<PickUp robot="alpha" item="kit" location="a"/>'
    return f"<Parallel><Sequence>{pick}{MOVE}{signal}{twice(give)}</Sequence><Sequence>{wait}{twice(take)}</Sequence></Parallel>"


def test_handover_and_its_fumble():
    has = [["carrying", "beta", "kit"]]
    fumble = {"type": "handover_fail", "giver": "alpha", "receiver": "beta", "item": "kit"}
    assert run(halves(), goal=has)["success"]
    assert run(halves(), [fumble], has)["reason"] == "tree_failed"
    assert run(halves(2), [fumble], has)["success"]
    assert not run(halves(2), [fumble | {"times": 2}], has)["success"]


def test_stall_is_seen_only_when_asked_for():
    body = '<WaitReady robot="alpha" item="kit" from="beta"/>'
    assert run(body, attrs='mrbtp_bridge="faithful_v1"')["reason"] == "stalled_no_progress"
    assert run(body)["reason"] == "cycle_limit"


def test_aliases():
    body = MOVE.replace("MoveTo", "DriveTo")
    assert run(body, goal=THERE, skill_aliases={"DriveTo": "MoveTo"})["success"]
    assert run(body, goal=THERE)["reason"] == "error: unknown node tag 'DriveTo'"


@pytest.mark.parametrize("domain", DOMAINS)
def test_sampled_missions_run_to_their_goal(domain):
    seen = Counter()
    for tier in ("T1", "T2", "T3"):
        for k in range(4):
            m = sample_mission(domain, tier, str(k))
            if m is None:
                continue
            start, goal = (frozenset(map(tuple, m[x])) for x in ("init_dynamic", "goal"))
            world = world_of(m)
            steps = [world.ground(n, b) for n, b in m["steps"]]
            final = replay(start, steps)
            xml = compile_tree(m, m["steps"])
            assert final is not None and goal <= final and judge(m, xml)["success"]
            if any(f["type"] == "blocked_edge" for f in m["faults"]):
                assert "<ClearPath" in xml
                assert judge(m, xml.replace("<ClearPath", "<ClearPathX"))["reason"].startswith("error: unknown node tag")
            seen[tier] += 1
    assert seen["T1"] and seen["T2"]


def test_planner():
    world, start = world_of(META), frozenset(map(tuple, META["init_dynamic"]))
    found = plan(world, start, frozenset({("item_at", "kit", "c")}), ["MoveTo", "PickUp", "PlaceDown"])
    assert [a.name for a in found] == ["PickUp", "MoveTo", "MoveTo", "PlaceDown"]
    assert plan(world, start, frozenset({("at", "alpha", "a")}), ["MoveTo"]) == []
    assert plan(world, start, frozenset({("at", "alpha", "nowhere")}), ["MoveTo"]) is None


def test_corpus(spark):
    built = missions.build_corpus(spark, "test", 20, "t").cache()
    again = missions.build_corpus(spark, "test", 20, "t")
    want = {(r.domain, r.tier): r.n for r in missions.quotas(spark, "test", 20).collect()}
    got = {(r.domain, r.tier): r["count"] for r in built.groupBy("domain", "tier").count().collect()}
    assert got == want
    assert sorted(r.record_id for r in built.collect()) == sorted(r.record_id for r in again.collect())


def test_diagnosis_of_damage(spark):
    runs = trees.damaged(missions.build_corpus(spark, "test", 20, "d")).withColumn("run", F.concat_ws("/", "damage", "domain", "tier", F.col("no").cast("string")))
    got = Counter((r.run.split("/")[0], r.success, r.error_type) for r in missions.diagnose(runs, "run").collect())
    assert all(ok and kind is None for name, ok, kind in got if name == "none")
    kinds = {name: {k for n, ok, k in got if n == name and not ok} for name in trees.DAMAGES}
    assert kinds["no_block"] == {"structural_parse"} and kinds["missing_attr"] <= {"missing_attr"}
    assert kinds["undefined_subtree"] <= {"structural_tree"} and kinds["unknown_tag"] <= {"hallucinated_node", "deadlock"}
    assert "attr_value_hallucinated" in kinds["wrong_place"]
    assert kinds["no_recovery"] <= {"fault_recovery_missing", "battery_recovery_missing", "handover_miscoord", "deadlock"}


def test_error_types(spark):
    meta = json.dumps(META | {"goal": THERE, "faults": [BLOCKED]})
    cases = {
        "fault_recovery_missing": tree(MOVE), "condition_guard_failed": tree(AT_B), "position_precondition_missing": tree('<PickUp robot="beta" item="kit" location="a"/>'),
        "missing_intermediate_leg": tree('<MoveTo robot="alpha" from="a" to="c"/>'), "goal_segment_missing": tree(AT_A), "deadlock": tree('<WaitReady robot="alpha" item="kit" from="beta"/>'),
        "other_precondition_missing": tree('<PlaceDown robot="alpha" item="kit" location="a"/>'), "other": tree("<Fallback/>"),
    }
    rows = spark.createDataFrame([(k, meta, x) for k, x in cases.items()], "k string, meta string, xml string")
    assert {r.k: r.error_type for r in missions.diagnose(rows, "k").collect()} == {k: k for k in cases}


def test_features(spark):
    xml = tree(f"<Fallback>{MOVE}<Sequence>{CLEAR}{MOVE}</Sequence></Fallback>")
    r = trees.features(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert (r.n_fb, r.n_sync, r.n_co, r.depth, r.n_nodes, r.stage) == (1, 0, 0, 4, 7, 3)
