"""Records of numeric families, drawn by counter.

A record depends on (seed, family, key) only: its uniform numbers come from
hashes of these three, so any row can be made alone, on any task, again.  Keys
come from a table.  Batches are solved a family at a time in stacks.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ground_truth as G
from . import sampling

#: Uniform numbers of a record, four to an MD5.
SLOTS = 24
#: Prompt openers, one by key.
OPENERS = ("State the result first, then the decisive step.", "Work from the given data only.", "Show the calculation that decides.", "Name the convention, then compute.")
ROLE = "You check and solve control engineering problems from the data given and invent none."
FAMILIES = tuple(sorted(k for k, kind in G.KINDS.items() if kind.draw))


def uniforms(seed: int, family: Column, key: Column, slots: int = SLOTS) -> Column:
    """array<double> of `slots` numbers in [0, 1): 32 bits of MD5 each."""
    digests = [F.md5(F.concat_ws(":", F.lit(str(seed)), family, key.cast("string"), F.lit(str(i)))) for i in range(-(-slots // 4))]
    return F.array(*[F.conv(F.substring(digests[i // 4], 1 + 8 * (i % 4), 8), 16, 10).cast("double") / 2.0**32 for i in range(slots)])


def family_of(seed: int, key: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """The family of a key, by hash."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % len(families)
    return F.element_at(F.array(*map(F.lit, families)), (place + 1).cast("int"))


def held_out(families: tuple[str, ...], seed: int, share: float = 0.1) -> list[str]:
    """The families that a split keeps apart, at least one: whole families, so none is on both sides."""
    order = sorted(families, key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).hexdigest())
    return sorted(order[: max(1, round(share * len(families)))])


def _shown(record: dict, names: list[str]) -> str:
    return ", ".join(f"{n} = {json.dumps(record[n], default=float)}" for n in names)


def _json(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), default=float)


def rendered(family: str, record: dict, opener: str) -> tuple[str, str, str, str, str]:
    """(prompt, answer, record, what it gives, what it claims), the last three as JSON with sorted keys."""
    kind = G.KINDS[family]
    given, claims = kind.given.split(), [c.partition(":")[0] for c in kind.claims.split()]
    prompt = f"{opener} {kind.task} Data: {_shown(record, given)}."
    return prompt, f"Result: {_shown(record, claims)}. Recomputed from the data given.", _json(record), _json({n: record[n] for n in given}), _json({n: record[n] for n in claims})


MADE = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", "answer", "record", "given", "claims")])
CHECKED = T.StructType([*MADE.fields, T.StructField("verified", T.BooleanType())])


def _drawn(family: pd.Series, key: pd.Series, u: pd.Series) -> pd.DataFrame:
    out: list = [("",) * 5] * len(family)
    for name, rows in family.groupby(family).groups.items():
        places = family.index.get_indexer(rows)
        for i, record in zip(places, G.make_records(name, np.stack(u.iloc[places].to_numpy()))):
            out[i] = rendered(name, record, OPENERS[hash_of(key.iloc[i]) % len(OPENERS)])
    return pd.DataFrame(out, columns=MADE.names)


@F.pandas_udf(MADE)
def _made(family: pd.Series, key: pd.Series, u: pd.Series) -> pd.DataFrame:
    return _drawn(family, key, u)


@F.pandas_udf(CHECKED)
def _made_and_checked(family: pd.Series, key: pd.Series, u: pd.Series) -> pd.DataFrame:
    made = _drawn(family, key, u)
    return made.assign(verified=pd.array(G.check_records(made["record"].tolist())[0], "boolean"))


def hash_of(key: str) -> int:
    """A number of a key that no process salts."""
    return sum((i + 1) * ord(c) for i, c in enumerate(key))


def records(keys: DataFrame, key: str, seed: int, families: tuple[str, ...] = FAMILIES, share: float = 0.1, check: bool = False) -> DataFrame:
    """(key, family, split, messages, metadata) of one record a row of keys; metadata.ground_truth is JSON and metadata.solution_sha256 its digest.

    check adds verified, the recomputation from that JSON, in the worker that
    made it: a second Python step would need a second worker a task.
    """
    rows = keys.select(F.col(key).cast("string").alias("key")).withColumn("family", family_of(seed, F.col("key"), families))
    rows = rows.withColumn("made", (_made_and_checked if check else _made)("family", "key", uniforms(seed, F.col("family"), F.col("key"))))
    domains = F.create_map(*[F.lit(x) for f in families for x in (f, G.KINDS[f].domain)])
    metadata = F.struct(
        F.concat_ws("_", "family", "key").alias("id"), F.element_at(domains, F.col("family")).alias("domain"), "family", F.col("family").alias("split_group"), F.lit("numeric").alias("task_type"),
        F.lit("solver").alias("generator"), F.struct(F.lit("recomputation").alias("verifier"), F.lit("passed_at_generation").alias("status")).alias("verification"),
        F.col("made.record").alias("ground_truth"), F.sha2("made.record", 256).alias("solution_sha256"), F.lit("approved").alias("status"),
    )
    split = F.when(F.col("family").isin(held_out(families, seed, share)), "test").otherwise("train")
    return rows.select("key", "family", split.alias("split"), F.array(_say("system", F.lit(ROLE)), _say("user", F.col("made.prompt")), _say("assistant", F.col("made.answer"))).alias("messages"), metadata.alias("metadata"), *([F.col("made.verified")] if check else []))


#: Tools of trajectories, by family.
TOOLS = {"zoh_discretization": "exact_zoh", "continuous_lqr": "continuous_lqr", "scalar_cbf_filter": "cbf_safety_filter"}
#: Requests that can't be met as asked: family -> (what is asked, what is missing).
MISSING = {
    "requirements_before_robust_synthesis": ("a robust controller", ("plant model", "uncertainty bounds", "performance weights", "sample time", "actuator limits")),
    "requirements_before_pid_gains": ("Kp, Ki and Kd", ("plant dynamics", "sample time", "actuator limits", "noise level", "overshoot requirement")),
    "requirements_before_kalman_gain": ("the Kalman gain", ("measurement equation", "process covariance", "measurement covariance", "initial covariance", "sensor timing")),
    "requirements_before_mpc_move": ("the first control move", ("prediction model", "sample time", "constraints", "objective weights", "current state")),
    "requirements_before_discretization": ("Ad and Bd", ("A and B matrices", "sample time", "hold convention", "delays", "units")),
    "requirements_before_identification": ("the model coefficients", ("input/output data", "sample time", "excitation", "model structure", "noise assumptions")),
}


def _say(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def requests_without_data(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, family, messages, ground_truth) of requests that lack what they need: the answer names what is missing and computes nothing."""
    names = tuple(sorted(MISSING))
    lookup = lambda values: F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), values(n))]), F.col("family"))
    rows = keys.select(F.col(key).cast("string").alias("key")).withColumn("family", family_of(seed, F.concat(F.lit("missing:"), F.col("key")), names))
    asked, missing = lookup(lambda n: F.lit(MISSING[n][0])), lookup(lambda n: F.array(*map(F.lit, MISSING[n][1])))
    prompt = F.concat(F.lit("Give me "), asked, F.lit(" for plant "), "key", F.lit(". That is all I know."))
    answer = F.concat(F.lit("This cannot be computed from what is given. Please provide: "), F.array_join(missing, ", "), F.lit(". Then compute "), asked, F.lit(" and verify the result on held-out data."))
    truth = F.to_json(F.struct(F.lit("underspecified_requirements").alias("kind"), F.lit(False).alias("can_compute_final_design"), F.lit(True).alias("forbid_numeric_controller_coefficients"), F.concat(missing, F.array(F.lit("cannot be computed"), F.lit("verify"))).alias("required_answer_terms")))
    return rows.select("key", "family", F.array(_say("system", F.lit(ROLE)), _say("user", prompt), _say("assistant", answer)).alias("messages"), truth.alias("ground_truth"))


def trajectories(keys: DataFrame, key: str, seed: int, refusals: float = 1 / 7, train: float = 0.85) -> DataFrame:
    """(key, family, split, messages, ground_truth) of a record a key: a tool call with its result, or a request that lacks data.

    The split is a cut of the hash order of all keys, so the training side has
    exactly the floor of its share.
    """
    refused = sampling.uniform(F.lit(f"{seed}:refuse"), F.col(key).cast("string")) < refusals
    without = requests_without_data(keys.filter(refused), key, seed)
    families = tuple(sorted(TOOLS))
    rows = keys.filter(~refused).select(F.col(key).cast("string").alias("key")).withColumn("family", family_of(seed, F.col("key"), families))
    rows = rows.withColumn("made", _made("family", "key", uniforms(seed, F.col("family"), F.col("key"))))
    tool = F.element_at(F.create_map(*[F.lit(x) for f in families for x in (f, TOOLS[f])]), F.col("family"))
    call = F.concat(F.lit('<tool_call>{"name":"'), tool, F.lit('","arguments":'), "made.given", F.lit("}</tool_call>"))
    messages = F.array(_say("system", F.lit(ROLE)), _say("user", F.col("made.prompt")), _say("assistant", call), _say("tool", F.col("made.claims")), _say("assistant", F.col("made.answer")))
    both = rows.select("key", "family", messages.alias("messages"), F.col("made.record").alias("ground_truth")).unionByName(without)
    # places are given to hashes alone; texts join them once
    order = keys.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("all"), F.md5(F.concat(F.lit(f"{seed}:split:"), F.col(key).cast("string"))).alias("h"))
    cut = sampling.places(order, "all", ["h", "key"]).select("key", F.when(F.col("place") <= F.floor(F.col("size") * train), "train").otherwise("valid").alias("split"))
    return both.join(cut, "key").select("key", "family", "split", "messages", "ground_truth")


def first_successes(attempts: DataFrame, family: str, order: str, valid: Column, quotas: dict[str, int], patience: int = 4) -> DataFrame:
    """attempts with attempt and place: of each family the first rows that are valid, up to its quota, among its first patience * quota attempts."""
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(family))
    tried = sampling.places(attempts.filter(F.col(family).isin(*quotas)), family, [order]).withColumnRenamed("place", "attempt").drop("size")
    made = tried.filter(valid & (F.col("attempt") <= patience * limit))
    return sampling.places(made, family, ["attempt"]).filter(F.col("place") <= limit).drop("size")
