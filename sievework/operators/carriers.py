"""Claims of a carrier registry: nine emitters over a snapshot, each with one claim, a low-grade claim, or the reason why it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months after which a filing is stale, inspections that a rate needs, power units that a crash rate needs, how far drivers may exceed staff.
STALE_MONTHS, MIN_INSPECTIONS, SMALL_INSPECTIONS, MIN_FLEET, CONFLICT_RATIO = 24, 20, 100, 20, 0.25
LOW_GRADE_MOST = 0.4


def is_private(classes: Column) -> Column:
    """Whether a registrant hauls its own freight only: unknown (null) without a classification, never "for hire" by default."""
    low = F.transform(classes, lambda c: F.lower(c))
    return F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, F.lit(None).cast("boolean")).when(F.exists(low, lambda c: F.contains(c, F.lit("for hire"))), False).otherwise(F.exists(low, lambda c: F.contains(c, F.lit("private"))))


def _claim(topic: str, strength, confidence, state="unknown", low: Column | str = "", value=None) -> Column:
    """A claim; a low-grade one is a weak clue of grade C with a bounded confidence, and says which bar it missed."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    low = col(low)
    graded = low != ""
    return F.struct(
        F.lit(topic).alias("topic"), col(state).alias("state"), F.when(graded, "weak_clue").otherwise(col(strength)).alias("strength"), F.when(graded, "C").otherwise("A").alias("grade"),
        F.round(F.when(graded, F.least(col(confidence), F.lit(LOW_GRADE_MOST))).otherwise(col(confidence)).cast("double"), 2).alias("confidence"),
        low.alias("low_grade"), F.coalesce(col(value).cast("double") if value is not None else F.lit(None).cast("double")).alias("value"), F.lit("").alias("skipped"),
    )


def _skip(topic: str, reason: str) -> Column:
    return F.struct(F.lit(topic).alias("topic"), *[F.lit(None).cast(t).alias(n) for n, t in (("state", "string"), ("strength", "string"), ("grade", "string"), ("confidence", "double"), ("low_grade", "string"), ("value", "double"))], F.lit(reason).alias("skipped"))


def emitters() -> dict[str, Column]:
    """A struct for each emitter over the columns of a snapshot; null where it has nothing to say and nothing to explain."""
    c = F.col
    conf, units, drivers = c("confidence"), c("power_units"), c("drivers")
    age = F.date_diff(c("data_as_of"), c("filed_on")) / 30.44
    private = is_private(c("classes"))
    fleet = (
        F.when(units.isNull() & drivers.isNull(), _skip("fleet_scale", "neither power units nor drivers were read"))
        .when((F.coalesce(units, F.lit(0)) == 0) & (F.coalesce(drivers, F.lit(0)) == 0), _claim("fleet_scale", "weak_clue", 0.4, low="nil fleet return", value=0))
        .otherwise(_claim("fleet_scale", "weak_clue", conf - F.when(age > STALE_MONTHS, 0.10).otherwise(0.0), value=units))
    )
    authority, kind, n = F.coalesce(c("authorized_for"), F.lit("")), F.coalesce(c("entity_type"), F.lit("")), F.coalesce(units, F.lit(0))
    broker = (n == 0) & F.contains(authority, F.lit("Broker"))
    model = F.when((authority == "") & (kind == ""), _skip("operating_model", "neither authority nor entity type was read")).otherwise(_claim("operating_model", F.when(broker, "committed_action").otherwise("weak_clue"), conf, value=n))

    def out_of_service(who: str, topic: str):
        seen, rate, nation = c(f"{who}_inspections"), c(f"{who}_oos_pct"), c(f"{who}_national_pct")
        low = F.concat(seen.cast("string"), F.lit(f" inspections, below the {MIN_INSPECTIONS}-inspection floor"))
        return (
            F.when(seen.isNull() | rate.isNull() | nation.isNull(), _skip(topic, "inspections or rates were not read"))
            .when(seen == 0, _skip(topic, "no inspection in the window"))
            .when(seen < MIN_INSPECTIONS, _claim(f"{who}_out_of_service_rate", "weak_clue", 0.4, low=low, value=c(f"{who}_oos")))
            .otherwise(_claim(topic, "measured_result", conf - F.when(seen < SMALL_INSPECTIONS, 0.10).otherwise(0.0), F.when(rate > nation, "legacy_constraint").otherwise("unknown"), value=F.round(rate - nation, 2)))
        )

    crashes = F.coalesce(c("crashes_total"), F.lit(0))
    crash = (
        F.when(n <= 0, None)
        .when(crashes == 0, _claim("crash_exposure_rate", "weak_clue", 0.4, low="zero crashes in the window", value=0))
        .otherwise(_claim("crash_exposure_rate", "measured_result", conf, value=F.when(n >= MIN_FLEET, F.round(crashes / n * 100, 1))))
    )
    active = F.contains(F.upper(F.coalesce(c("usdot_status"), F.lit(""))), F.lit("ACTIVE"))
    lag_low = F.concat(F.lit("filing "), F.floor(age).cast("string"), F.lit(f" months old, inside the {STALE_MONTHS}-month window"))
    lag = (
        F.when(age.isNull() | ~active | (age < STALE_MONTHS / 2), None)
        .when(age <= STALE_MONTHS, _claim("registry_record_maintenance_lag", "weak_clue", 0.35, low=lag_low, value=F.floor(age)))
        .otherwise(_claim("registry_record_maintenance_lag", "weak_clue", F.greatest(conf - 0.05, F.lit(0.3)), "legacy_constraint", value=F.floor(age)))
    )
    staff, known = c("employees").try_cast("int"), F.coalesce(c("employees").cast("string"), F.lit(""))
    workforce = (
        F.when((known != "") & staff.isNull(), _skip("workforce_scale_conflict", "the number of employees is no number"))
        .when((F.coalesce(drivers, F.lit(0)) == 0) | (F.coalesce(staff, F.lit(0)) == 0), _skip("workforce_scale_conflict", "drivers or employees are unknown"))
        .when(drivers <= staff, None)
        .when(drivers <= staff * (1 + CONFLICT_RATIO), _claim("workforce_scale_conflict", "weak_clue", 0.35, low="drivers exceed employees by less than the 25% band", value=drivers - staff))
        .otherwise(_claim("workforce_scale_conflict", "weak_clue", conf, value=drivers - staff))
    )
    refused = F.contains(F.upper(F.coalesce(c("authority_status"), F.lit(""))), F.lit("NOT AUTHORIZED"))
    gap = (
        F.when(refused & private.isNull(), _skip("for_hire_authority_not_active", "no classification, so private carriage can't be excluded"))
        .when(refused & ~private, _claim("for_hire_authority_not_active", "measured_result", F.least(conf, F.lit(0.7)), "legacy_constraint"))
    )
    others = F.size(F.filter("family", lambda f: f["name_key"] != c("name_key")))
    family = F.when(others > 0, _claim("multi_entity_operating_structure", "repeated_pattern", 0.55, value=others + 1)).when(F.size("family") > 0, _skip("multi_entity_operating_structure", "registrations under the same name are duplicates"))
    return {
        "fleet_scale": fleet, "operating_model": model, "vehicle_oos": out_of_service("vehicle", "vehicle_maintenance_out_of_service_rate"), "driver_oos": out_of_service("driver", "driver_compliance_out_of_service_rate"),
        "crash_exposure": crash, "registry_maintenance": lag, "workforce_conflict": workforce, "for_hire_authority_gap": gap, "multi_entity_structure": family,
    }


def carrier_claims(snapshots: DataFrame, key: str) -> DataFrame:
    """(key, emitter, topic, state, strength, grade, confidence, low_grade, value, skipped): the claims of each snapshot, and why an emitter that could not say anything has none.

    A snapshot has power_units, drivers, classes, authorized_for, authority_status, entity_type, usdot_status, filed_on, data_as_of, crashes_total, employees (as stated), confidence, name_key,
    family (other registrations, with name_key) and for vehicle_ and driver_: inspections, oos, oos_pct, national_pct.
    """
    each = F.array(*[F.struct(F.lit(name).alias("emitter"), claim.alias("c")) for name, claim in emitters().items()])
    return snapshots.select(key, F.explode(each).alias("e")).where("e.c IS NOT NULL").select(key, "e.emitter", "e.c.*")
