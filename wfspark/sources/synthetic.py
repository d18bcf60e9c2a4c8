"""Seeded synthetic tables of the shapes that the operators expect.

Each table is a set of column expressions over ``id`` (0, 1, ...) and draws that are hashes of id, seed and a number: ``U1`` uniform, ``Z1`` normal. So a table is
the same in any partitioning, grows to any size without a pass over the driver, and rows don't depend on their number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _drawn(expression: str, seed: int) -> str:
    uniform = lambda k: f"((pmod(xxhash64(id, {seed}, {k}), 1000003) + 0.5) / 1000003)"
    normal = lambda k: f"(sqrt(-2 * ln({uniform(f'{k}01')})) * cos(2 * pi() * {uniform(f'{k}02')}))"
    return re.sub(r"\b([UZ])(\d+)\b", lambda m: (uniform if m[1] == "U" else normal)(m[2]), expression)


def _pick(values: str, draw: str) -> str:
    items = values.split()
    return f"element_at(array({', '.join(map(repr, items))}), 1 + int({len(items)} * {draw}))"


def _id(prefix: str, number: str, digits: int = 4) -> str:
    return f"format_string('{prefix}_%0{digits}d', int({number}))"


_DEPARTMENT = _pick("Operations Sales Support Finance Engineering", "U91")
_EMPLOYEE = _id("EMP", "id")
_DATE = "cast(date_add(date'2022-01-03', int({})) as timestamp)"
_EXIT = "int(U81 < 1 / (1 + exp(-({}))))"

#: Name: default rows, columns in order (a later one may use an earlier one), and a condition on the rows.
TABLES: dict[str, tuple[int, dict[str, str], str]] = {
    "store_roster": (2500, {
        "employee_id": _id("EMP", "id", 5), "store_id": _id("STORE", "50 * U1", 3), "dept_code": _id("DEPT", "8 * U2", 2), "tenure_weeks": "1 + bigint(260 * U3)",
        "weekly_overtime_hours": "if(U4 < 0.01, 42.5, greatest(0, 5 + 3 * Z5))", "store_dept": "concat(store_id, '_', dept_code)", "turnover_event": "bigint(U6 < 0.2)",
    }, ""),
    "compensation_equity": (1200, {
        "employee_id": _EMPLOYEE, "department": _DEPARTMENT, "job_level": "1 + bigint(5 * U1)", "job_grade": "concat('IC', job_level)", "tenure_years": "15 * U2", "performance_rating": "1 + bigint(5 * U3)",
        "band_min": "50000.0 + 20000 * job_level", "band_max": "band_min * 1.5", "band_mid": "(band_min + band_max) / 2", "band_midpoint": "band_mid", "base_salary": "band_mid * (1 + 0.12 * Z4) + 500 * tenure_years",
    }, ""),
    "equity_fairness": (1000, {
        "employee_id": _EMPLOYEE, "demographic_group": "bigint(U1 < 0.45)", "tenure_years": "12 * U2", "education_years": "12 + bigint(9 * U3)", "job_level": "1 + bigint(5 * U4)", "performance_rating": "1 + bigint(5 * U5)",
        "certifications": "bigint(4 * U6)", "hours_worked": "38 + 4 * Z7", "base_salary": "40000 + 1800 * tenure_years + 1500 * education_years + 6000 * job_level - 3500 * demographic_group + 3000 * Z8",
        "true_merit_qualification": "bigint(performance_rating >= 4)", "promotion_recommendation": "bigint(true_merit_qualification = 1 and U9 < 0.9 - 0.25 * demographic_group)",
    }, ""),
    "causal_uplift": (1200, {
        "employee_id": _EMPLOYEE, "tenure_years": "12 * U1", "prior_performance": "3 + 0.8 * Z2", "flight_risk": "U3", "overtime_hours": "greatest(0, 6 + 4 * Z4)", "manager_quality": "U5",
        "true_propensity": "1 / (1 + exp(-(0.8 * flight_risk - 0.4 + 0.3 * (prior_performance - 3))))", "treatment_enrolled": "bigint(U6 < true_propensity)", "true_cate": "0.3 * flight_risk - 0.1 * manager_quality",
        "retained_1yr": "bigint(U7 < least(0.98, 0.75 - 0.4 * flight_risk + true_cate * treatment_enrolled + 0.2 * manager_quality))", "productivity_score": "50 + 6 * prior_performance + 10 * true_cate * treatment_enrolled + 4 * Z8",
    }, ""),
    "time_in_position": (500, {
        "employee_id": _EMPLOYEE, "department": _DEPARTMENT, "job_level": "1 + bigint(5 * U1)", "performance_rating": "1 + bigint(5 * U2)", "time_in_position_months": "1 + 59 * U3 * U4", "baseline_flight_risk": "U5",
        "last_role_change_date": "date_format(add_months(date'2025-01-01', -int(time_in_position_months)), 'yyyy-MM-dd')",
    }, ""),
    "compensation_velocity": (1200, {
        "employee_id": _EMPLOYEE, "tenure_years": "12 * U1", "performance_rating": "1 + bigint(5 * U2)", "is_local_anomaly": "bigint(U3 < 0.03)", "annual_salary_growth_pct": "2 + 0.8 * performance_rating + 0.6 * Z4 + 9 * is_local_anomaly", "promotion_velocity": "0.2 + 0.05 * performance_rating + 0.05 * Z5",
    }, ""),
    "store_profiles": (250, {
        "store_id": _id("STORE", "id", 3), "is_anomaly": "bigint(id % 17 = 0)",
        **{name: f"{low} + {high - low} * U{k} + is_anomaly * {3 * (high - low)} * (U{k}1 - 0.5)" for k, (name, low, high) in enumerate((
            ("overtime_ratio", 0, 0.2), ("unplanned_absenteeism", 0.01, 0.08), ("turnover_rate", 0.1, 0.6), ("tenure_median", 10, 120), ("training_completion", 0.6, 1), ("break_compliance", 0.8, 1), ("customer_satisfaction", 3, 5),
            ("shrink_rate", 0.005, 0.03), ("sales_per_labor_hour", 80, 220), ("manager_turnover", 0, 0.4), ("promotion_rate", 0, 0.2), ("eNPS_score", -20, 60), ("schedule_adherence", 0.7, 1),
        ), 21)},
    }, ""),
    "safety_incidents": (2500, {
        "assoc_tenure_weeks": "1 + bigint(200 * U1)", "mgr_tenure_months": "1 + bigint(60 * U2)", "weekly_overtime": "greatest(0, 5 + 5 * Z3)", "safety_training_score": "100 - 40 * U4", "shift_chaos_index": "3 * U5",
        "safety_incident_event": "bigint(" + _EXIT.format("-3 + 0.1 * weekly_overtime * shift_chaos_index - 0.02 * assoc_tenure_weeks") + ")",
    }, ""),
    "turnover_inflection": (1800, {
        "weekly_overtime_hours": "25 * U1", "comp_ratio": "0.7 + 0.6 * U2", "commute_minutes": "5 + 85 * U3", "manager_1on1_frequency": "4 * U4", "peer_turnover_rate": "0.5 * U5",
        "is_terminated": "bigint(" + _EXIT.format("-2 + 2 * int(weekly_overtime_hours > 12) + 1.5 * int(comp_ratio < 0.9) + 0.02 * commute_minutes - 0.3 * manager_1on1_frequency") + ")",
    }, ""),
    "overtime_dag": (1000, {
        "manager_absence": "Z1", "workload_surge": "Z2", "understaffing": "0.8 * manager_absence + Z3", "overtime_hours": "0.7 * understaffing + 0.6 * workload_surge + Z4", "burnout_index": "0.9 * overtime_hours + Z5", "turnover_risk": "0.8 * burnout_index + 0.5 * manager_absence + Z6",
    }, ""),
    "turnover_breakdown": (6, {
        "department": "element_at(array('Operations', 'Sales', 'Support', 'Finance', 'Engineering', 'People'), 1 + int(id % 6))", "headcount_y0": "100 + bigint(400 * U1)", "turnover_rate_y0": "0.05 + 0.3 * U2", "headcount_y1": "bigint(headcount_y0 * (0.8 + 0.4 * U3))",
        "turnover_rate_y1": "turnover_rate_y0 * (0.7 + 0.6 * U4)", "turnover_count_y0": "bigint(headcount_y0 * turnover_rate_y0)", "turnover_count_y1": "bigint(headcount_y1 * turnover_rate_y1)",
    }, ""),
    "shift_managers": (400, {
        "shift_id": _id("SHIFT", "id"), "store_id": _id("STORE", "id % 4", 3), "manager_id": _id("MGR", "id % 8", 2), "is_weekend": "bigint(U1 < 2 / 7D)", "foot_traffic": "200 + 80 * U2 + 60 * is_weekend", "staff_hours": "40 + 10 * U3",
        "true_manager_alpha": "double(id % 8) - 3.5", "observed_throughput": "0.5 * foot_traffic + 2 * staff_hours + 4 * true_manager_alpha + 5 * Z4",
    }, ""),
    "labour_panel": (4160, {
        "store_id": _id("STORE", "id div 416", 3), "dept_id": _id("DEPT", "id div 104 % 4", 2), "week": "id % 104", "year": "2022 + week div 52", "week_of_year": "1 + week % 52", "headcount": "20 + 5 * (id div 104 % 4) + bigint(round(3 * Z1))",
        "assigned_hours": "headcount * (32 + 8 * U2)", "turnover_count": "bigint(4 * U3)", "turnover_rate": "turnover_count / headcount",
    }, ""),
    "foot_traffic": (540, {
        "store_id": _id("STORE", "id div 180", 3), "day_index": "id % 180", "date": _DATE.format("day_index"), "day_of_week": "day_index % 7", "day_name": "date_format(date, 'EEEE')", "is_weekend": "bigint(day_of_week >= 5)", "true_baseline": "300 + 0.5 * day_index + 50 * sin(2 * pi() * day_index / 60)",
        "daily_noise": "15 * Z1", "observed_foot_traffic": "true_baseline + 80 * is_weekend + daily_noise", "observed_labor_hours": "observed_foot_traffic / 6 + 3 * Z2",
    }, ""),
    "cohort_overtime": (624, {"week": "id div 12", "employee_id": _id("EMP", "id % 12", 2), "is_exemplar": "id % 12 = 0", "overtime_hours": "if(is_exemplar, 14 + week / 8D, 6) + 1.5 * Z1"}, ""),
    "headcount": (156, {"week_index": "id", "date": _DATE.format("7 * id"), "headcount": "1000 + bigint(2 * id + 40 * sin(id / 26D) + 8 * Z1)"}, ""),
    "labour_hours": (104, {"week": "id", "date": _DATE.format("7 * id"), "true_baseline": "5000 + 10 * id + 300 * sin(2 * pi() * id / 52)", "labor_shock": "if(U1 < 0.05, 600 * Z2, 0)", "labor_hours": "true_baseline + labor_shock + 80 * Z3", "scheduled_hours": "true_baseline + 40 * Z4"}, ""),
    "seasonal_demand": (156, {"week": "id", "true_trend": "1000 + 3.0 * id", "true_seasonality": "150 * sin(2 * pi() * id / 52)", "observed_labor_demand": "true_trend + true_seasonality + 25 * Z1"}, ""),
    "regimes": (104, {"week": "id", "true_latent_state": "id div 13 % 3", "weekly_overtime_hours": "3 + 6 * true_latent_state + Z1", "absence_callout_rate": "0.03 + 0.04 * int(true_latent_state = 2) + 0.005 * Z2"}, ""),
    "policy_panel": (180, {
        "location_id": _id("LOC", "id div 12", 2), "quarter_idx": "id % 12", "quarter_name": "concat('Q', 1 + quarter_idx % 4, '_', 2022 + quarter_idx div 4)", "is_treated_unit": "bigint(id div 12 < 3)", "is_post_period": "bigint(quarter_idx >= 8)",
        "turnover_rate": "0.2 + 0.01 * (id div 12) + 0.003 * quarter_idx - 0.05 * is_treated_unit * is_post_period + 0.004 * Z1",
    }, ""),
    "scheduling_pilot": (720, {
        "store_id": _id("STORE", "id div 24", 3), "week_idx": "id % 24", "is_pilot_store": "bigint(id div 24 < 5)", "is_post_rollout": "bigint(week_idx >= 16)", "turnover_rate": "0.3 + 0.004 * (id div 24) + 0.02 * sin(week_idx / 4D) - 0.06 * is_pilot_store * is_post_rollout + 0.006 * Z1",
    }, ""),
    "seasonal_curves": (208, {
        "series_id": "element_at(array('BENCHMARK', 'STORE_IN_SYNC', 'STORE_PHASE_SHIFTED', 'STORE_ABNORMAL'), 1 + int(id div 52))", "t": "id % 52", "v": "case id div 52 when 2 then 100 + 30 * sin(2 * pi() * (t - 6) / 52) when 3 then 100 + 30 * sin(2 * pi() * t / 9) else 100 + 30 * sin(2 * pi() * t / 52) end + 2 * Z1",
    }, ""),
    "shift_sequences": (156, {
        "series_id": "element_at(array('benchmark_peer', 'associate_vacation_gap', 'associate_erratic_schedule'), 1 + int(id div 52))", "t": "id % 52", "v": "case when id div 52 = 1 and t between 20 and 23 then 0 when id div 52 = 2 then 60 * U1 else 38 + Z2 end",
    }, ""),
    "role_distributions": (24, {
        "store": "element_at(array('BENCHMARK', 'STORE_A', 'STORE_B', 'STORE_C'), 1 + int(id div 6))", "role": "concat('ROLE_', 1 + id % 6)", "p": "element_at(array(0.40D, 0.25D, 0.15D, 0.10D, 0.07D, 0.03D), 1 + int((id % 6 + if(id div 6 = 3, 2, 0)) % 6))",
    }, ""),
    "rewards": (2600, {"employee_id": _id("EMP", "id div 52"), "award_week": "id % 52", "award_tier": "case when U1 < 0.2 then 'Gold' when U1 < 0.5 then 'Silver' else 'Bronze' end", "award_amount": "case award_tier when 'Gold' then 500D when 'Silver' then 200D else 75D end"}, "U2 < 0.08"),
    "shift_schedules": (600, {"department": _DEPARTMENT, "shift_id": _id("SHIFT", "id"), "shift_type": _pick("Morning Day Evening Night Weekend OnCall", "U1 * U2"), "duration_hours": "4 + 8 * U3", "split_shift": "U4 < 0.1"}, ""),
    "call_outs": (480, {"series_id": _id("SITE", "id div 120", 2), "t": "id % 120 + U1 * U2"}, "U3 < 0.35 or (id % 120) % 30 < 4"),
    "absence_spells": (1500, {
        "employee_id": _id("EMP", "id div 12"), "department": _DEPARTMENT, "absence_start_date": "date_format(date_add(date'2024-01-01', int(30 * (id % 12) + 20 * U1)), 'yyyy-MM-dd')", "duration_days": "1 + bigint(6 * U2 * U3)",
        "absence_end_date": "date_format(date_add(to_date(absence_start_date), int(duration_days) - 1), 'yyyy-MM-dd')", "absence_reason": _pick("Sick Family Injury Personal", "U4"), "is_planned": "U5 < 0.2",
    }, "U6 < 0.4"),
    "career_log": (2000, {"employee_id": _id("EMP", "id div 4"), "role_level": "concat('L', 1 + id % 4)", "start_year": "2018 + 1.5 * (id % 4) + U1", "duration_years": "0.5 + 0.9 * U2", "end_year": "start_year + duration_years"}, "id % 4 = 0 or U3 < 0.6"),
    "career_movement": (500, {"employee_id": _EMPLOYEE, "career_history": "transform(sequence(1, 2 + int(4 * U1)), k -> concat('ROLE_', 1 + pmod(xxhash64(id, k), 3) + 2 * (k - 1)))", "current_role": "element_at(career_history, -1)"}, ""),
    "network_nodes": (120, {"employee_id": _EMPLOYEE, "department": _id("DEPT", "id div 24", 2), "job_level": "1 + bigint(5 * U1)", "performance_rating": "1 + bigint(5 * U2)", "intended_archetype": "case when id % 24 = 0 then 'broker' when id % 24 < 4 then 'hub' else 'member' end"}, ""),
    "network_edges": (720, {
        "source": _id("EMP", "id % 120"), "target": _id("EMP", "pmod(if(U1 < 0.8, (id % 120) div 24 * 24 + int(24 * U2), int(120 * U2)), 120)"), "meeting_hours": "4 * U3", "email_count": "bigint(40 * U4)", "slack_messages": "bigint(120 * U5)",
        "weight": "0.3 * meeting_hours + 0.05 * email_count + 0.02 * slack_messages",
    }, "source <> target"),
    "multigraph_edges": (400, {
        "relation": "element_at(array('works_on', 'has_skill', 'member_of'), 1 + int(id % 3))", "source": _id("EMP", "id div 3 % 80", 2), "target": "case id % 3 when 0 then " + _id("PRJ", "16 * U1", 2) + " when 1 then " + _id("SKILL", "24 * U1", 2) + " else " + _id("DEPT", "id div 3 % 5", 1) + " end",
    }, ""),
    "hierarchy": (400, {
        "snapshot": "if(id < 200, 'before', 'after')", "employee_id": _id("EMP", "id % 200"), "manager_id": "if(id % 200 = 0, null, " + _id("EMP", "(id % 200 - 1) div if(id < 200, 7, 9)") + ")", "department": _DEPARTMENT, "job_level": "1 + bigint(5 * U1)",
        "performance_rating": "1 + bigint(5 * U2)", "baseline_flight_risk": "U3",
    }, ""),
}


def synthetic(spark: SparkSession, name: str, rows: int | None = None, seed: int = 42) -> DataFrame:
    """The named table. ``rows`` counts ids; tables with a condition keep some of them."""
    size, columns, condition = TABLES[name]
    df = spark.range(size if rows is None else rows)
    for column, expression in columns.items():
        df = df.withColumn(column, F.expr(_drawn(expression, seed)))
    if condition:
        df = df.where(_drawn(condition, seed))
    return df.select(*columns)
