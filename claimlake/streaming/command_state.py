"""Claim commands with one state value per claim: what a command meets is what the state holds, and no table is read.

Gates that a command passes or fails by itself are columns, as in the batch operator. The state machine then sees only what
depends on the claim: whether it exists, its status, and what it says. A claim's commands of one batch are taken in ``seq``
order; the ones of later batches count after them. The state of a claim is one small JSON text, whatever its history.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimlake.functions import text as tx
from claimlake.operators import ledger
from claimlake.sources.sinks import status_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What leaves the state machine: one row per command, and per claim one row with its state after the batch.
OUT = "claim_id string, seq bigint, cmd string, rejection string, state string"
BORN = ("claim_type string, proposed_status string, speaker string, source_refs array<string>, sensitivity string, created date")
MADE = (f"{BORN}, status string, claim string, quote string, evidence_refs array<string>, superseded_by array<string>, "
        "updated date, last_verified date")


def judged(commands: DataFrame) -> DataFrame:
    """(claim_id, seq, cmd, why, target, born, evidence, text, quote, quoted, by, date): each command with all it may set, as text."""
    said = F.coalesce("new_quote", F.lit(""))
    born = F.to_json(F.struct("claim_type", "proposed_status", "speaker", "source_refs", "sensitivity", F.col("date").alias("created")))
    replaces = F.when((F.col("cmd") == "set_status"), tx.filled(F.col("superseded_by")))
    written = F.when(ledger.written(F.col("evidence")), F.to_json("evidence"))
    return commands.select("claim_id", "seq", "cmd", ledger.gates_alone().alias("why"), "target", born.alias("born"), written.alias("evidence"),
                           F.col("new_text").alias("text"), tx.strip(said).alias("quote"), tx.blockquote(said).alias("quoted"),
                           replaces.alias("by"), F.col("date").cast("string").alias("date"))


def step(state: dict | None, c: dict) -> tuple[dict | None, str | None]:
    """The state after a command, and why the command was refused."""
    if c["why"] is not None:
        return state, c["why"]
    cmd = c["cmd"]
    if cmd == "create":
        if state:
            return state, "id taken"
        return {**json.loads(c["born"]), "status": "unverified", "claim": c["text"], "quote": c["quote"], "quoted": c["quoted"], "evidence_refs": [],
                "superseded_by": [], "updated": c["date"], "last_verified": None}, None
    if not state:
        return state, "no such claim"
    if cmd == "update_text":
        if state["status"] != "unverified":
            return state, "not unverified"
        if (state["claim"] or "") == c["text"]:
            return state, "unchanged"
        change = {"claim": c["text"]}
    elif cmd == "update_quote":
        if state["quoted"] == c["quoted"]:
            return state, "unchanged"
        change = {"quote": c["quote"], "quoted": c["quoted"]}
    else:
        change = {"status": c["target"]}
        if cmd == "promote" and c["evidence"]:
            change["evidence_refs"] = json.loads(c["evidence"])
        if cmd == "promote" and c["target"] == "verified":
            change["last_verified"] = c["date"]
        if c["by"]:
            change["superseded_by"] = [c["by"]]
    return {**state, **change, "updated": c["date"]}, None


class Claim(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("claim", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = json.loads(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        out = []
        for c in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            known, why = step(known, c)
            out.append((key[0], c["seq"], c["cmd"], why, None))
        if known:
            self.state.update((json.dumps(known),))
            out.append((key[0], None, None, None, json.dumps(known)))
        frame = pd.DataFrame(out, columns=["claim_id", "seq", "cmd", "rejection", "state"])
        yield frame.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stateful(commands: DataFrame) -> DataFrame:
    """The rows of ``OUT`` for a stream of commands; the session needs the state store of `ROCKS`."""
    return judged(commands).groupBy("claim_id").transformWithStateInPandas(Claim(), OUT, "Update", "None")


def audit_of(rows: DataFrame) -> DataFrame:
    outcome = F.when(F.col("rejection").isNull(), "applied").otherwise("rejected")
    return rows.filter("state is null").select("claim_id", "seq", "cmd", outcome.alias("outcome"), "rejection")


def claims_of(rows: DataFrame) -> DataFrame:
    made: Column = F.from_json("state", MADE)
    claims = rows.filter("state is not null").select("claim_id", made.alias("s")).select("claim_id", "s.*")
    return claims.select(*ledger.STATE).withColumn("folder", status_folder(F.col("status")))
