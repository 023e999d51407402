"""From raw telemetry of a fleet to one scale-out decision per job and control loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens import session
from loadlens.operators import anomaly, capacity, forecast, loop_arima, recovery, regression, scaleout
from loadlens.operators.scan import running
from loadlens.plans import tables as t


@dataclass(frozen=True)
class Settings:
    """Time base and limits. Durations named `*_steps` count grid steps."""

    step: int = 1
    loop_seconds: int = 60
    horizon_steps: int = forecast.TREND_HORIZON
    up_steps: int = recovery.UP_DOWNTIME
    down_steps: int = recovery.DOWN_DOWNTIME
    target_steps: int = scaleout.TARGET_RECOVERY
    stabilise_seconds: int = scaleout.STABILISE
    calm_seconds: int = scaleout.CALM
    max_scaleout: int = capacity.MAX_SCALEOUT

    @property
    def loop_steps(self) -> int:
        return self.loop_seconds // self.step


# The test tables hold hours, not seconds.
HOURLY = Settings(
    step=t.HOUR,
    loop_seconds=t.LOOP_HOURS * t.HOUR,
    horizon_steps=24,
    up_steps=3,
    down_steps=2,
    target_steps=12,
    calm_seconds=50_000,
    max_scaleout=t.MAX_SCALEOUT,
)


def flat_forecast(job_rows: DataFrame, settings: Settings) -> DataFrame:
    """The simplest model: the loop's mean workload, repeated."""
    level = job_rows.groupBy("job", "loop").agg(
        F.avg("workload").alias("level"),
        (F.max("ts") + F.make_dt_interval(secs=F.lit(settings.step))).alias("start"),
    )
    return level.select(
        "job", "loop", "start", F.array_repeat("level", settings.horizon_steps).alias("forecast")
    )


def arima_states(job_rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """What every loop knows of its job's workload, and the model versions of all jobs."""
    rows = session.materialise(job_rows.select("job", "loop", "ts", "workload"), "workload")
    slices = F.floor(F.unix_seconds("ts") / (7 * 86400))
    states = session.materialise(loop_arima.loop_states(rows, slice_by=slices), "states")
    versions = loop_arima.fleet_versions(
        rows, states, settings.horizon_steps, settings.step, slice_by=slices
    )
    return states, versions


def arima_forecast(job_rows: DataFrame, settings: Settings) -> DataFrame:
    """The model of the fleet: updated by every loop, replaced after streaks of bad forecasts."""
    states, versions = arima_states(job_rows, settings)
    made = loop_arima.forecast_loops(states, versions, settings.horizon_steps, settings.step)
    return session.materialise(made, "arima-forecasts")


def job_capacities(hours: DataFrame, job_rows: DataFrame) -> DataFrame:
    """`(job, loop, parallelism, capacity)` for every loop; capacity null where unknown.

    Reduced tables are written where a plan with several readers would repeat the work
    above them.
    """
    frames = capacity.loop_frames(hours, t.uptime(job_rows))
    reduced = session.materialise(capacity.loop_pods(frames), "loop-pods")
    pods = capacity.pod_capacity(reduced)
    facts = t.loop_facts(job_rows).select("job", "loop", "parallelism")
    loops = facts.join(capacity.job_capacity(pods), ["job", "loop"], "left")
    return session.materialise(loops, "loop-capacities")


def situations(hours: DataFrame, settings: Settings, model: DataFrame | None = None) -> DataFrame:
    """Everything a decision needs, one row per job and loop."""
    job_rows = t.job_hours(hours)
    table = session.materialise(
        capacity.capacity_table(job_capacities(hours, job_rows), settings.max_scaleout),
        "capacity-table",
    )
    aged = scaleout.since_last_rescale(
        table.select("job", "loop", "parallelism", "capacities"), settings.loop_seconds
    )
    trend = forecast.forecast_trend(job_rows, settings.horizon_steps, settings.step)
    if model is None:
        model = arima_forecast(job_rows, settings)
    accuracy = forecast.wape(job_rows, model, settings.step)
    chosen = forecast.choose_forecast(model, trend, accuracy)
    facts = t.loop_facts(job_rows).select("job", "loop", "avg_workload", "tail_workload", "lag")
    # A loop of a single sample has no trend to extrapolate: its forecast holds nulls.
    return aged.join(facts, ["job", "loop"]).join(
        chosen.select("job", "loop", "forecast", "source"), ["job", "loop"]
    )


def residual_hours(job_rows: DataFrame) -> DataFrame:
    """Workload less throughput; an hour without processed events reports no throughput."""
    throughput = job_rows.filter("throughput > 0").select("job", "ts", "throughput")
    rows = anomaly.residuals(job_rows.select("job", "ts", "workload"), throughput)
    return rows.select("job", "ts", "residual")


def rescale_epochs(facts: DataFrame) -> DataFrame:
    """Loops `(job, loop, parallelism)` with `previous` and `before` (parallelism and number of
    the loop before) and `epoch`, the rescales so far."""
    slices = F.floor(F.col("loop") / regression.LOOPS_PER_SLICE)
    linked = running(
        facts.select("job", "loop", "parallelism"),
        ["job"],
        ["loop"],
        slices,
        {"previous": ("lag", F.col("parallelism")), "before": ("lag", F.col("loop"))},
    )
    changed = F.coalesce((F.col("parallelism") != F.col("previous")).cast("int"), F.lit(0))
    return running(linked, ["job"], ["loop"], slices, {"epoch": ("sum", changed)})


def rescale_feedback(
    hours: DataFrame, found: DataFrame, settings: Settings, loop: Column, gap: int
) -> DataFrame:
    """Downtime to assume after each rescale: `(job, loop, epoch, direction, downtime)`.

    What was predicted for the new scale-out, one loop before, is compared with the recovery
    time observed until the next rescale: the mean length of its anomalies, scored by what was
    known before each loop. A rescale without prediction teaches nothing.
    """
    job_rows = t.job_hours(hours)
    epochs = session.materialise(rescale_epochs(t.loop_facts(job_rows)), "epochs")
    rows = residual_hours(job_rows).withColumn("loop", loop)
    rows = rows.join(epochs.select("job", "loop", "epoch"), ["job", "loop"])
    rows = session.materialise(rows, "epoch-residuals")
    known = anomaly.moments_before(rows).join(epochs.select("job", "loop", "epoch"), ["job", "loop"])
    known = known.withColumns({c: F.round(c, 6) for c in ("mean", "std")})
    flagged = anomaly.detect_anomalies(rows, known, ("job", "epoch"), gap, as_of=("loop",))
    flagged = session.materialise(flagged, "epoch-anomalies")
    seen = anomaly.observed_recovery_time(flagged, ("job", "epoch"), gap)
    # Only the loops before a rescale are asked.
    asked = epochs.filter(F.col("parallelism") != F.col("previous")).select("job", F.col("before").alias("loop"))
    predicted = recovery.predict_recovery(
        found.join(asked, ["job", "loop"], "left_semi"), settings.up_steps, settings.down_steps
    )
    predicted = predicted.select(
        "job",
        F.col("loop").alias("before"),
        F.col("scaleout").alias("parallelism"),
        F.col("recovery_time").alias("predicted"),
    )
    rescales = (
        epochs.filter(F.col("parallelism") != F.col("previous"))
        .join(predicted.filter("predicted IS NOT NULL"), ["job", "before", "parallelism"])
        .join(seen.select("job", "epoch", F.col("recovery_time").alias("observed")), ["job", "epoch"])
        .select(
            "job",
            "loop",
            "epoch",
            F.when(F.col("parallelism") > F.col("previous"), "up").otherwise("down").alias("direction"),
            "observed",
            "predicted",
        )
    )
    return recovery.adjust_downtime(rescales, settings.up_steps, settings.down_steps)


def with_downtimes(found: DataFrame, feedback: DataFrame, settings: Settings) -> DataFrame:
    """Situations with `up` and `down`, the downtimes that earlier rescales have taught.

    A rescale's own recovery is known once the next one happens.
    """
    epochs = rescale_epochs(found).select("job", "loop", "epoch")
    taught = feedback.select(
        "job",
        (F.col("epoch") + 1).alias("epoch"),
        F.when(F.col("direction") == "up", F.col("downtime")).alias("__up"),
        F.when(F.col("direction") == "down", F.col("downtime")).alias("__down"),
    )
    rows = epochs.join(taught, ["job", "epoch"], "left")
    known = running(
        rows,
        ["job"],
        ["loop"],
        F.floor(F.col("loop") / regression.LOOPS_PER_SLICE),
        {"up": ("last", F.col("__up")), "down": ("last", F.col("__down"))},
    ).select(
        "job",
        "loop",
        # A downtime that was corrected below nothing counts as none.
        F.greatest(F.coalesce("up", F.lit(settings.up_steps)), F.lit(0)).cast("int").alias("up"),
        F.greatest(F.coalesce("down", F.lit(settings.down_steps)), F.lit(0)).cast("int").alias("down"),
    )
    return found.join(known, ["job", "loop"])


def plan(
    hours: DataFrame,
    settings: Settings,
    model: DataFrame | None = None,
    feedback_gap: int | None = None,
) -> DataFrame:
    """Decisions for all loops. With `feedback_gap` (rows that anomalies tolerate between
    them) the assumed downtimes follow the observed recoveries."""
    found = situations(hours, settings, model)
    up, down = settings.up_steps, settings.down_steps
    if feedback_gap is not None:
        found = session.materialise(found, "situations")
        loop = F.floor(F.unix_seconds("ts") / settings.loop_seconds).cast("bigint")
        feedback = rescale_feedback(hours, found, settings, loop, feedback_gap)
        found = with_downtimes(found, session.materialise(feedback, "feedback"), settings)
        up, down = F.col("up"), F.col("down")
    return scaleout.plan_scaleout(
        found,
        up=up,
        down=down,
        stabilise=settings.stabilise_seconds,
        calm=settings.calm_seconds,
        target_recovery=settings.target_steps,
        loop_steps=settings.loop_steps,
    )


def reduced_hours(spark, sf_dir: str) -> DataFrame:
    """Hourly telemetry, written once for the many branches that read it."""
    return session.materialise(t.pod_hours(t.events(spark, sf_dir)), "pod-hours")
