"""Leases watched as they run out, from a stream of what happens to assets."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trovelight.fixed_values import LEASE_USED_UP
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

OUTPUT = "asset_id BIGINT, started_at TIMESTAMP, attempts INT, status STRING, error STRING"


def watch_leases(
    changes: DataFrame,
    lease_minutes: float = DEFAULTS.lease_minutes,
    max_attempts: int = DEFAULTS.max_attempts,
) -> DataFrame:
    """The leases that end without a result, as a stream of what their assets become.

    An asset that starts processing sets a timer of its own, kept in the stream's state; any later
    change of status clears it. When the timer runs out the asset is pending again, or failed once
    its attempts are used up.

    Args:
        changes: A streaming DataFrame (asset_id, status, started_at, attempts), one row per change.
        lease_minutes: How long a lease holds.
        max_attempts: Attempts an asset has.

    Returns:
        A streaming DataFrame (asset_id, started_at, attempts, status, error).
    """
    need(changes, "asset_id", "status", "started_at", "attempts")
    lease_ms = int(lease_minutes * 60_000)
    used_up = LEASE_USED_UP.format(attempts=max_attempts)

    def watch(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started_ms, attempts = state.get
            state.remove()
            failed = attempts >= max_attempts
            yield pd.DataFrame(
                {
                    "asset_id": [key[0]],
                    "started_at": [pd.Timestamp(started_ms, unit="ms")],
                    "attempts": [attempts],
                    "status": ["failed" if failed else "pending"],
                    "error": [used_up if failed else None],
                }
            )
            return
        # A result belongs to a lease; of several leases the last one counts.
        seen = pd.concat(batches).sort_values(["attempts", "started_ms"], na_position="first")
        running = seen[seen["status"] == "processing"]
        if len(running) and not len(seen[(seen["status"] != "processing") & (seen["attempts"] >= running["attempts"].max())]):
            last = running.iloc[-1]
            state.update((int(last["started_ms"]), int(last["attempts"])))
            state.setTimeoutDuration(max(1, int(last["started_ms"]) + lease_ms - state.getCurrentProcessingTimeMs()))
        elif state.exists:
            state.remove()

    return (
        changes.select(
            "asset_id", "status", F.unix_millis("started_at").alias("started_ms"), "attempts"
        )
        .groupBy("asset_id")
        .applyInPandasWithState(
            watch,
            OUTPUT,
            "started_ms BIGINT, attempts INT",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
