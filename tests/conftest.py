from __future__ import annotations

import os
import sys
from datetime import datetime, timezone
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from paytrace.sources.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, 4)
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


TX = ("transaction_id string, sender_id string, receiver_id string, amount decimal(18,4), t bigint, "
      "tx_type string, location string, device_id string")


def at(text: str) -> int:
    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp())


@pytest.fixture(scope="session")
def tx(spark):
    """Builds transfers from (sender, receiver, amount, time[, type, area, device])."""
    def build(rows):
        out = []
        for i, row in enumerate(rows):
            sender, receiver, amount, when, *rest = row
            rest = list(rest) + [None] * (3 - len(rest))
            t = when if isinstance(when, int) else at(when)
            out.append((f"T{i:05d}", sender, receiver, Decimal(str(amount)).quantize(Decimal("0.0001")), t, *rest))
        return spark.createDataFrame(out, TX)

    return build


def accounts(df, column="account_id"):
    return sorted({r[column] for r in df.collect()})
