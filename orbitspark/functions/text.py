"""Report text from one collected row; what is missing is named, never shown as zero."""

from __future__ import annotations


def value_text(v) -> str:
    if v is None:
        return "unavailable"
    if isinstance(v, bool):
        return "yes" if v else "no"
    return f"{v:.6g}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v)


def measure_text(m: dict | None) -> str:
    if m is None:
        return "unavailable: not recorded"
    if m["availability"] != "available":
        return f"unavailable: {m['reason']}"
    return value_text(m["value"]) + (f" {m['units']}" if m.get("units") else "")


def report(row: dict, alignment: dict) -> str:
    """Markdown of one run's diagnostics and alignment."""
    lines = ["# Run report", "", f"Status: {row['status']}", "", "## Alignment", ""]
    lines += [f"- {k}: {value_text(alignment.get(k))}" for k in ("status", "reason", "centre_method", "num_cameras", "planarity", "arc_coverage_deg", "sign_agreement") if k != "reason" or alignment.get(k)]
    lines += ["", "## Measures", "", f"- cameras registered: {value_text(row['cameras_registered'])} of {value_text(row['frames_selected'])}", f"- registration ratio: {measure_text(row['registration_ratio'])}"]
    lines += [f"- valid points: {value_text(row['num_points_valid'])}" + (" (at the cap, a lower bound)" if row["saturated"] else ""), f"- mean reprojection error: {measure_text(row['mean_reprojection_error'])}"]
    box = [f"- {c}: " + (f"{value_text(row[f'min_{c}'])} to {value_text(row[f'max_{c}'])}" if row[f"min_{c}"] is not None else f"unavailable: {row['reason']}") for c in "xyz"]
    return "\n".join([*lines, "", "## Extent in the aligned world, units unknown", "", *box, ""])


#: The sections of a report, in order.
SECTIONS = ("Conventions", "Alignment", "Input", "Integrity", "Assumptions", "Frames", "Reconstruction", "Measures", "Visual check", "Warnings", "Limits", "Reproduction")


def entries(doc: dict | None, keys: tuple[str, ...] | None = None) -> list[str]:
    """One line an entry: measures by their value or reason, all else as text; a missing document is named."""
    if doc is None:
        return ["unavailable: not recorded"]
    if "missing" in doc and len(doc) == 1:
        return [f"unavailable: {doc['missing']}"]
    out = []
    for k in keys or tuple(doc):
        v = doc.get(k)
        shown = measure_text(v) if isinstance(v, dict) and "availability" in v else ", ".join(f"{a}: {value_text(b)}" for a, b in v.items()) if isinstance(v, dict) else value_text(v)
        out.append(f"- {k.replace('_', ' ')}: {shown}")
    return out or ["none"]


def warning_lines(warnings: list[dict] | None) -> list[str]:
    return ["unavailable: not recorded"] if warnings is None else [f"- {w['code']}: {w['message']}" for w in warnings] or ["none"]


def full_report(run_id: str, documents: dict, notes: dict[str, str] | None = None) -> str:
    """Markdown of a run in twelve sections. ``documents`` has an entry (a dict) by section name; what is not there is named, never a failure."""
    status = documents.get("Status") or {}
    head = [f"# Run {run_id}", "", status.get("banner") or "status unavailable", ""]
    checks = documents.get("Visual check")
    for name in SECTIONS:
        head += [f"## {name}", ""]
        if name == "Warnings":
            head += warning_lines(status.get("warnings"))
        elif name == "Visual check" and isinstance(checks, dict) and "missing" not in checks:
            head += [f"- {item}: {c['result'].replace('_', ' ')}" + (f" ({c['note']})" if c.get("note") else "") for item, c in checks.items()]
        else:
            head += entries(documents.get(name))
        head.append("")
    if notes:
        head += ["## Preliminary values", "", *(f"- {k}: {v}" for k, v in notes.items()), ""]
    return "\n".join(head)


def comparison_text(exp: dict, metrics: list[dict]) -> str:
    """Markdown of one experiment: verdict or the reasons why there is none, and a table of the metrics by role."""
    lines = [f"# Experiment {exp['exp_id']}", ""]
    if exp["exit_code"]:
        lines += ["Not compared:", "", *(f"- {r}" for r in exp["reasons"])]
    else:
        lines += [f"Verdict: {exp['verdict']}", "", f"- variant against baseline: {value_text(exp['relative_difference'])}", f"- repeat against baseline: {value_text(exp['repeat_difference'])}"]
    by: dict = {}
    for m in metrics:
        by.setdefault(m["metric"], {})[m["branch"]] = measure_text(m)
    lines += ["", "| Metric | Baseline | Variant | Repeat |", "| - | - | - | - |"]
    lines += [f"| {name} | " + " | ".join(roles.get(r, "not run") for r in ("baseline", "variant", "repeat")) + " |" for name, roles in by.items()]
    return "\n".join([*lines, ""])


def panels(status: dict, metrics: list[dict], label: str) -> dict[str, str]:
    """A viewer's texts: status, warnings, metrics and how many points are shown."""
    return {
        "status": status["banner"], "warnings": "\n".join(warning_lines(status.get("warnings"))), "metrics": "\n".join(f"{m['metric']}: {measure_text(m)}" for m in metrics), "info": label,
    }


def terminal_summary(row: dict, where: str) -> str:
    return f"{row['status']}: {value_text(row['cameras_registered'])} of {value_text(row['frames_selected'])} cameras, {value_text(row['num_points_valid'])} points -> {where}"
