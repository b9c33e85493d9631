"""From text to typed tables: header roles, money, dates, sales with a reason for each row that is left out."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.operators.audit import SALES
from cellarium.operators.thresholds import NO_CUSTOMER

# Words that tell a column's role, in order of precedence.
SALES_ROLES = {
    "date": ("data", "emissao", "dt"), "product": ("produto", "item", "sku", "descricao", "servico"), "customer": ("cliente", "razao", "cnpj"),
    "value": ("valor", "vlr", "total", "liquido", "preco"), "quantity": ("qtd", "quant", "quantidade"), "cost": ("custo",),
    "category": ("categoria", "familia", "linha"), "store": ("loja", "filial", "unidade"), "salesperson": ("vendedor",),
    "payment": ("forma_pagto", "pagamento", "pagto"),
}
STOCK_ROLES = {
    "sku": ("sku", "produto", "item", "codigo"), "cost": ("custo",), "qty_on_hand": ("qtd_atual", "estoque", "saldo", "quantidade"),
    "last_movement": ("ultimo_mov", "movimentacao"), "category": ("categoria", "familia", "linha"),
}
CUSTOMER_ROLES = {"customer_id": ("cliente_id", "codigo", "id"), "phone": ("telefone", "fone", "celular"), "document": ("cpf", "cnpj", "documento")}
FINANCE_ROLES = {"period": ("mes", "periodo", "competencia"), "store": ("loja", "filial", "unidade"), "service_revenue": ("receita_servico", "servicos")}
REQUIRED = {
    "sales": ("date", "product", "customer", "value"), "stock": ("sku", "cost", "qty_on_hand", "last_movement"), "customers": ("customer_id",),
    "finance": ("period", "store", "service_revenue"),
}
BAD_DATE, BAD_VALUE, NO_PRODUCT = "data_invalida", "valor_nao_numerico", "produto_ausente"


class MissingRole(ValueError):
    """A required role has no column."""


class AmbiguousDates(ValueError):
    """A column has both day-first and month-first dates."""


def plain(text: str) -> str:
    """Without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def roles(headers: list[str], words: dict[str, tuple[str, ...]], required: tuple[str, ...], override: dict[str, str] | None = None) -> dict[str, str]:
    """The column of each role. An override wins; else the first column, not yet taken, that has one of the role's words."""
    found = dict(override or {})
    for role, signs in words.items():
        if role not in found:
            free = (h for h in headers if h not in found.values())
            if (column := next((h for h in free if any(w in plain(h) for w in signs)), None)) is not None:
                found[role] = column
    if missing := [r for r in required if r not in found]:
        raise MissingRole(f"no column for {missing} among {headers}; name it in a mapping")
    return found


def money(text: Column) -> Column:
    """A number from text with currency signs. Of both separators the last is the decimal one; a lone comma is decimal; a
    lone dot is decimal unless three digits follow it or it occurs again. Null if it is no number."""
    return from_bare(bare_money(text))


def bare_money(text: Column) -> Column:
    return F.regexp_replace(text, r"[R$\x{20AC}\s]", "")


def from_bare(bare: Column) -> Column:
    dots, commas = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))), F.instr(bare, ",")
    comma_last = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    english, brazilian = F.replace(bare, F.lit(","), F.lit("")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    thousands = (dots > 1) | bare.rlike(r"\.[0-9]{3}$")
    chosen = (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, brazilian).otherwise(english))
        .when(commas > 0, brazilian)
        .when(dots > 0, F.when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare))
        .otherwise(bare)
    )
    return number_or_null(chosen)


def number_or_null(text: Column) -> Column:
    """Plain decimal text as a double; anything else (also NaN and infinity by name) is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))


def table_number(text: Column) -> Column:
    """A number of a dashboard table: the last separator is the decimal one, a lone dot too."""
    s = F.trim(text)
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    plain_text = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return number_or_null(F.when((F.instr(s, ",") > 0) & comma_last, plain_text).otherwise(F.replace(s, F.lit(","), F.lit(""))))


def dotted_number(text: Column) -> Column:
    """A number of the semantic model: dots are thousands, a comma is decimal."""
    return number_or_null(F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def date_style(df: DataFrame, column: str, style: str | None = None) -> str:
    """ISO, DMY or MDY for the column, from one aggregate over it; raises if it truly mixes the last two."""
    c = F.trim(F.col(column))
    first, second = (F.regexp_extract(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i).try_cast("int") for i in (1, 2))
    seen = df.agg(
        F.avg(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}").cast("double")).alias("iso"), F.bool_or((first > 12) & (second <= 12)).alias("dmy"), F.bool_or((second > 12) & (first <= 12)).alias("mdy")
    ).first()
    if (seen.iso or 0) > 0.5:
        return "ISO"
    if style:
        return style.upper()
    if seen.dmy and seen.mdy:
        raise AmbiguousDates(f"column {column} has both DD/MM and MM/DD dates; name its date_format (DMY or MDY)")
    return "DMY"


def dates(text: Column, style: str) -> Column:
    """Timestamps of text with the day (DMY) or the month (MDY) first, or in ISO order; null if it is no date."""
    first, second = (2, 1) if style == "MDY" else (1, 2)
    # The parts of a day-first date are put in ISO order: one cast then reads either.
    ordered = F.regexp_replace(F.trim(text), r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", f"$3-${second}-${first}")
    return F.when(ordered.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"), ordered.try_cast("timestamp_ntz"))


@dataclass(frozen=True)
class Loaded:
    accepted: DataFrame
    discarded: DataFrame

    def summary(self) -> DataFrame:
        """Rows by reason; a null reason is what was accepted. The counts add up to the rows read."""
        kept = self.accepted.select(F.lit(None).cast("string").alias("reason"))
        return kept.unionByName(self.discarded.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def load_sales(raw: DataFrame, source: str, override: dict[str, str] | None = None, row_column: str = "row_no") -> Loaded:
    """Sales of raw text columns with a row number. A quantity multiplies the value; no quantity counts as one."""
    override = dict(override or {})
    style = override.pop("date_format", None)
    headers = [c for c in raw.columns if c != row_column]
    role = roles(headers, SALES_ROLES, REQUIRED["sales"], override)
    style = date_style(raw, role["date"], style)
    get = lambda r: F.nullif(F.trim(F.col(f"`{role[r]}`")), F.lit("")) if r in role else F.lit(None).cast("string")
    texts = raw.select(*(get(r).alias(f"_{r}") for r in SALES_ROLES), F.col(row_column).cast("long").alias("source_row"))
    # One higher-order call parses the three: its parts are evaluated once, where nested projections would repeat each within
    # the next until no generated method can hold them.
    bare = F.transform(F.array(*(F.col(f"_{r}") for r in ("value", "quantity", "cost"))), bare_money)
    parsed = texts.withColumn("_numbers", F.transform(bare, from_bare))
    typed = parsed.withColumns({name: F.col("_numbers")[i] for i, name in enumerate(("v", "q", "c"))})
    rows = typed.select(
        dates(F.col("_date"), style).alias("date"), F.col("_product").alias("product"), F.coalesce("_customer", F.lit(NO_CUSTOMER)).alias("customer"),
        (F.col("v") * F.coalesce("q", F.lit(1.0))).alias("value"), F.col("q").alias("quantity"), F.col("c").alias("entry_cost"),
        F.col("_category").alias("category"), F.col("_store").alias("store"), F.col("_salesperson").alias("salesperson"), F.col("_payment").alias("payment_method"),
        F.lit(source).alias("source_file"), "source_row",
    )
    reason = F.when(F.col("date").isNull(), BAD_DATE).when(F.col("value").isNull(), BAD_VALUE).when(F.col("product").isNull(), NO_PRODUCT)
    rows = rows.withColumn("reason", reason)
    accepted = rows.filter("reason IS NULL").select(*(c.split()[0] for c in SALES.split(", ")))
    return Loaded(accepted, rows.filter("reason IS NOT NULL").select("source_file", "source_row", "reason"))


def by_roles(raw: DataFrame, words: dict[str, tuple[str, ...]], required: tuple[str, ...], numbers: tuple[str, ...] = (), dated: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a side table (stock, customers, finance) under their roles' names, typed."""
    role = roles(raw.columns, words, required)
    out = []
    for r, column in role.items():
        c = F.nullif(F.trim(F.col(f"`{column}`")), F.lit(""))
        out.append((money(c) if r in numbers else dates(c, date_style(raw, column)) if r in dated else c).alias(r))
    return raw.select(*out)
