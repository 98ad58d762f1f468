"""S1 + T1: requests that a client sends again count once.

A client that gets no answer sends its body again, after 1, 3 and 5 seconds, and cannot know
whether the first one was applied; a counter would count twice. Here a request has an id, and the
stream keeps the ids of the last while in its state store: a body whose id is there is
dropped, whatever micro-batch, and whatever run of the stream, it comes in. An id is
forgotten when the watermark on the time of arrival has passed it by ``within``, so the state
holds the requests of that while only.

Requests without an id are all kept, as nothing tells them apart. A request whose time of arrival lies
more than ``within`` before the latest one is too late to be judged and dropped: the time is
the server's own, so only a source that is read far out of order has such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.sources import json_ingest
from tallyfold.streaming.fold_stream import start_state_stream
from tallyfold.streaming.results_store import rocksdb

#: Three repeats within 9 seconds, with 10 seconds for each answer, and some room.
WITHIN = "2 minutes"


def once_per_request(requests: DataFrame, request_id: str = "request_id", received: str = "received", within: str = WITHIN) -> DataFrame:
    """The stream without the repeats of a request id."""
    # A request without an id gets one of its own.
    own = F.when(F.col(request_id).isNull(), F.uuid())
    told = requests.withColumn("_own", own).withWatermark(received, within)
    return told.dropDuplicatesWithinWatermark([request_id, "_own"]).drop("_own")


def request_updates(requests: DataFrame, order: str, batch_size: int) -> DataFrame:
    """The updates of the bodies that decode and are valid as a whole; a body's ``order`` and the place in it give ``seq``."""
    decoded = json_ingest.decode_batch_bodies(requests)
    rows = json_ingest.accepted_updates(decoded, order)
    return rows.withColumn("seq", F.col(order) * batch_size + F.col("pos")).select("seq", "id", "type", "delta", "value")


def start_request_stream(
    requests: DataFrame, state_root: str, checkpoint: str, order: str, batch_size: int, within: str = WITHIN, trigger: dict | None = None
) -> StreamingQuery:
    """Requests (``request_id, received, body`` and their ``order``) -> state folders, each request once."""
    with rocksdb(requests.sparkSession):
        return start_state_stream(request_updates(once_per_request(requests, within=within), order, batch_size), state_root, checkpoint, trigger)
