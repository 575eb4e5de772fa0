import random

import pandas as pd
import pytest

from larkspur.sources.store import Store
from larkspur.streaming import live

SCHEMA = "chain_key string, object string, valid_from long"


def batch(facts):
    """The state machine over all facts in order of time."""
    out, chains, times = {}, {}, {}
    for chain, value, at in sorted(facts, key=lambda f: (f[0], f[2], f[1])):
        held, version = chains.get(chain, (None, 0))
        action = "INSERT" if not version else "NOOP" if held == value else "SUPERSEDE"
        version += action != "NOOP"
        chains[chain] = (value, version)
        n = times[chain, at, value] = times.get((chain, at, value), -1) + 1
        out[chain, at, value, n] = (action, version)
    return out


class _Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, value):
        self.value = value

    update = put


def folded(batches, keep=None):
    """The processor by itself, chain by chain, with its state in memory."""
    chains, table, late = {}, {}, []
    for facts in batches:
        for chain in sorted({f[0] for f in facts}):
            p = chains.setdefault(chain, live._Chain(keep))
            if not hasattr(p, "history"):
                p.history, p.base = _Held(), _Held()
            frame = pd.DataFrame([f for f in facts if f[0] == chain], columns=["chain_key", "object", "valid_from"])
            for out in p.handleInputRows((chain,), iter([frame]), None):
                for r in out.itertuples(index=False):
                    if r.action == "LATE":
                        late.append((r.chain_key, r.valid_from, r.object))
                    else:
                        table[r.chain_key, r.valid_from, r.object, r.nth] = (r.action, r.version)
    return table, late, chains


@pytest.mark.parametrize("seed", range(12))
def test_any_order_of_arrival_is_the_batch(seed):
    rng = random.Random(seed)
    facts = [(rng.choice("ab"), rng.choice("xyz"), rng.randint(0, 12)) for _ in range(60)]
    rng.shuffle(facts)
    cuts = sorted(rng.sample(range(60), 7))
    batches = [facts[a:b] for a, b in zip([0, *cuts], [*cuts, 60]) if a < b]
    table, late, _ = folded(batches)
    assert table == batch(facts) and not late


def test_what_a_chain_remembers_is_bounded():
    facts = [("a", f"o{k // 2}", 10 * k) for k in range(50)]
    batches = [[f] for f in facts] + [[("a", "late", 405)], [("a", "too late", 5)]]
    table, late, chains = folded(batches, keep=100)
    assert late == [("a", 5, "too late")] and table == batch([f for b in batches[:-1] for f in b])
    assert len(chains["a"].history.value) == 12 and chains["a"].base.value[1] == 380


def test_stream_with_late_facts_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    facts = [(rng.choice("abc"), rng.choice("xy"), rng.randint(0, 9)) for _ in range(40)]
    store = Store(spark, str(tmp_path / "store"), 2)
    for part in (facts[:20], facts[20:30], facts[30:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        live.keep_facts(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), store, "facts", str(tmp_path / "check")).awaitTermination()
    got = {(r.chain_key, r.valid_from, r.object, r.nth): (r.action, r.version) for r in store.read("facts", live.FOLDED).collect()}
    assert got == batch(facts)
