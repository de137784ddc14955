"""Charts as one HTML file without outside scripts. Figures are aggregated in Spark; of more than ``max_points`` rows, neighbours are averaged, and the page says so."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.access import as_time
from ..operators.ordering import numbered
from ..operators.profiling import profile


@dataclass
class ChartConfig:
    title: str = "Chart"
    kind: str = "line"
    x_field: str | None = None
    y_fields: Sequence[str] = field(default_factory=list)
    width: int = 960
    height: int = 480
    max_points: int = 5000
    colors: Sequence[str] = ("#2f6db3", "#c8553d", "#3b8f5a", "#8a5aa8", "#b8892b", "#4a4a4a")
    show_points: bool = True
    show_grid: bool = True
    show_legend: bool = True
    stacked: bool = False
    moving_average: int = 0
    y_from_zero: bool = False
    theme: str = "light"


KINDS = ("line", "bar", "scatter", "area", "pie", "radar")


def default_chart_config() -> ChartConfig:
    return ChartConfig()


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:24px;background:{paper};color:{ink}}}td,th{{padding:2px 12px;text-align:right}}</style></head><body>
<h1>{title}</h1><div><select id="kind">{kinds}</select> <label><input type="checkbox" id="avg"> moving average</label></div>
<svg id="c" width="{width}" height="{height}"></svg><table>{stats}</table>
<script>const D={data};
function draw(){{const s=document.getElementById('c'),k=document.getElementById('kind').value,m=document.getElementById('avg').checked;
const W=D.width-80,H=D.height-60;let o='';const all=D.series.flatMap(x=>x.values).filter(v=>v!==null);
let lo=Math.min(...all),hi=Math.max(...all);if(D.zero||k==='bar'||k==='area')lo=Math.min(0,lo);if(lo===hi)hi=lo+1;
const n=D.labels.length,X=i=>60+(n>1?i*W/(n-1):W/2),Y=v=>20+H-(v-lo)*H/(hi-lo);
for(let g=0;g<=4;g++){{const v=lo+(hi-lo)*g/4;if(D.grid)o+=`<line x1=60 x2=${{60+W}} y1=${{Y(v)}} y2=${{Y(v)}} stroke="#8884"/>`;o+=`<text x=4 y=${{Y(v)+4}} fill="currentColor">${{v.toPrecision(4)}}</text>`;}}
D.series.forEach((q,j)=>{{let v=q.values;if(m)v=v.map((_,i)=>{{const w=v.slice(Math.max(0,i-D.window+1),i+1).filter(x=>x!==null);return w.length?w.reduce((a,b)=>a+b)/w.length:null}});
const c=D.colors[j%D.colors.length],p=v.map((y,i)=>y===null?null:[X(i),Y(y)]).filter(x=>x);
if(k==='bar')v.forEach((y,i)=>{{if(y!==null)o+=`<rect x=${{X(i)-4+j*4}} width=4 y=${{Math.min(Y(y),Y(0))}} height=${{Math.abs(Y(y)-Y(0))}} fill="${{c}}"/>`}});
else{{if(k!=='scatter')o+=`<polyline points="${{p.map(x=>x.join()).join(' ')}}" fill="${{k==='area'?c+'44':'none'}}" stroke="${{c}}"/>`;
if(D.points||k==='scatter')p.forEach(x=>o+=`<circle cx=${{x[0]}} cy=${{x[1]}} r=2.5 fill="${{c}}"/>`);}}
if(D.legend)o+=`<text x=${{70+j*140}} y=14 fill="${{c}}">${{q.name}}</text>`;}});
const step=Math.max(1,Math.ceil(n/8));D.labels.forEach((l,i)=>{{if(i%step===0)o+=`<text x=${{X(i)}} y=${{H+44}} text-anchor="middle" fill="currentColor">${{l}}</text>`}});s.innerHTML=o;}}
document.getElementById('kind').value=D.kind;document.getElementById('kind').onchange=draw;document.getElementById('avg').onchange=draw;draw();</script></body></html>
"""


def interactive_chart(df: DataFrame, path: str, config: ChartConfig | None = None, order: Sequence[str] = ()) -> None:
    """A page with the numeric fields (or ``y_fields``) against ``x_field``; no rows raise."""
    config = config or ChartConfig()
    fields = profile(df)
    numeric = [f.name for f in fields if f.kind == "numeric"]
    x = config.x_field or next((f.name for f in fields if f.kind != "numeric"), None)
    ys = [y for y in (config.y_fields or numeric) if y != x and y in df.columns]
    total = df.count()
    if not total:
        raise ValueError("there are no rows to draw")
    rows = points(df, x, ys, order, config.max_points, total).orderBy("point").drop("point").collect()  # max_points at most
    esc = html.escape
    data = {
        "labels": [esc(r[0] or "") for r in rows], "series": [{"name": esc(y), "values": [r[i + 1] for r in rows]} for i, y in enumerate(ys)],
        "kind": config.kind, "width": config.width, "height": config.height, "colors": list(config.colors), "grid": config.show_grid,
        "points": config.show_points, "legend": config.show_legend, "zero": config.y_from_zero, "window": config.moving_average or 5,
    }
    stats = "<tr><th>field</th><th>count</th><th>min</th><th>max</th><th>mean</th><th>deviation</th></tr>"
    for f in fields:
        if f.kind == "numeric":
            stats += f"<tr><td>{esc(f.name)}</td><td>{f.count}</td>" + "".join(f"<td>{v:.6g}</td>" for v in (f.min, f.max, f.mean, f.stddev)) + "</tr>"
    if total > config.max_points:
        stats += f"<caption>{total} rows, drawn as {len(rows)} points: each is the mean of neighbouring rows.</caption>"
    dark = config.theme == "dark"
    page = _PAGE.format(
        title=esc(config.title), width=config.width, height=config.height, stats=stats, data=json.dumps(data).replace("</", "<\\/"),
        kinds="".join(f"<option>{k}</option>" for k in KINDS), paper="#1c1c1c" if dark else "#fff", ink="#eee" if dark else "#222",
    )
    with open(path, "w", encoding="utf-8") as out:
        out.write(page)


def points(df: DataFrame, x: str | None, ys: Sequence[str], order: Sequence[str] = (), most: int = 5000, total: int | None = None) -> DataFrame:
    """``(point, x, y0, y1, ...)`` for all rows, at most ``most`` of them: runs of neighbours share one, with their first ``x`` and mean values.

    Neighbours along ``order``, else along ``x``; without either rows are as they come.
    """
    total = df.count() if total is None else total
    label = F.col(f"`{x}`").cast("string") if x else F.lit("")
    made = df.select(label.alias("x"), *[F.col(f"`{y}`").try_cast("double").alias(f"y{i}") for i, y in enumerate(ys)], *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order or ([x] if x else []))])
    keys = [c for c in made.columns if c.startswith("o")]
    at = F.monotonically_increasing_id()
    if total <= most:
        numbered_ = made.select("*", at.alias("n")) if not order else numbered(made, keys, "n")
        return numbered_.select(F.col("n").alias("point"), "x", *[f"y{i}" for i in range(len(ys))])
    if not keys:
        made, keys = made.withColumn("o0", at), ["o0"]
    n = numbered(made, keys, "n")
    point = F.floor((F.col("n") - 1) * most / F.lit(total)).cast("long")
    return n.groupBy(point.alias("point")).agg(F.min_by("x", "n").alias("x"), *[F.avg(f"y{i}").alias(f"y{i}") for i in range(len(ys))])


def quick_chart(df: DataFrame, x: str, y: str, path: str) -> None:
    interactive_chart(df.select(x, y), path, ChartConfig(title=f"{y} vs {x}", x_field=x, y_fields=[y]))


def time_series_chart(df: DataFrame, time: str, values: Sequence[str], path: str, config: ChartConfig | None = None) -> None:
    """A line chart of rows sorted by time."""
    config = config or ChartConfig(title="Time series")
    config.kind, config.x_field, config.y_fields = "line", time, list(values)
    at = as_time(F.col(f"`{time}`"), df.schema[time].dataType)
    interactive_chart(df.withColumn(time, at), path, config, [time])
