"""Votes as a stream: a sentence is consolidated when its votes are complete.

A keyed state buffers the parsed votes of incomplete sentences.  When the last
vote arrives (or the timeout passes) the buffered rows are released, and each
micro-batch of released rows runs the batch operator.  The checkpoint takes the
place of a list of finished sentences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from compovec.functions import responses as J
from compovec.operators import votes as V

SCHEMA = "report_id string, sentence_idx int, vote_no int, error string, items string"
DONE = "done"
#: Sentences of a report that share one state entry: a call of the state function costs far more than a vote.
BLOCK = 64


def released_votes(parsed: DataFrame, n_votes: int = 5, timeout_ms: int | None = None) -> DataFrame:
    """Vote rows of the sentences that became complete, each sentence once.

    A state entry holds up to ``BLOCK`` neighbouring sentences of a report, each with
    its own deadline.  The buffer of a sentence holds at most ``n_votes`` rows: a repeated vote
    number replaces nothing, and a finished sentence keeps only a marker.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # sentence -> [deadline, its votes or the marker]; a null index has the key ""
        block = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timeout_ms else 0
        rows: list[tuple] = []

        def release(sentence: str, held: dict) -> None:
            idx = int(sentence) if sentence else None
            rows.extend((key[0], idx, *r) for r in sorted(held.values(), key=lambda r: r[0]))

        if not state.hasTimedOut:
            touched = set()
            for pdf in batches:
                for s, v, e, i in zip(pdf["sentence_idx"], pdf["vote_no"], pdf["error"], pdf["items"]):
                    s = "" if pd.isna(s) else str(int(s))
                    held = block.setdefault(s, [None, {}])[1]
                    if held != DONE:
                        held.setdefault(str(v), [int(v), e if isinstance(e, str) else None, i])
                        touched.add(s)
            for s in touched:
                held = block[s][1]
                if len(held) >= n_votes:
                    release(s, held)
                    held = DONE
                block[s] = [now + timeout_ms if timeout_ms else None, held]
        if timeout_ms:
            for s in [s for s, (due, _) in block.items() if due is not None and due <= now]:
                held = block.pop(s)[1]
                if held != DONE:
                    release(s, held)
        if block:
            state.update((json.dumps(block),))
            dues = [due for due, _ in block.values() if due is not None]
            if dues and timeout_ms:
                state.setTimeoutDuration(min(dues) - now)
        else:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=["report_id", "sentence_idx", "vote_no", "error", "items"])
            yield out.astype({"sentence_idx": "Int32"})

    rows = parsed.select(*V.KEYS, "vote_no", "error", F.to_json("items").alias("items"))
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    rows = rows.withColumn("block", F.floor(F.col("sentence_idx") / BLOCK))
    return rows.groupBy("report_id", "block").applyInPandasWithState(step, SCHEMA, "held string", "append", kind)


def start(votes: DataFrame, out: str, checkpoint: str, n_votes: int = 5, timeout_ms: int | None = None, **consolidation) -> StreamingQuery:
    """Consolidate a stream of vote rows into ``out``, one folder per micro-batch.

    A batch that is retried after a failure overwrites its own folder, so the
    output has every sentence once.
    """
    released = released_votes(V.parse_votes(votes), n_votes, timeout_ms)

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = batch.withColumn("items", F.from_json("items", f"array<{J.ITEM}>"))
        labels = V.consolidate(parsed, n_votes=n_votes, **consolidation)
        labels.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return released.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
