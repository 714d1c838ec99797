"""The usage ledger: per account a fold over its events in time order.

Whether a request is allowed depends on all before it, so there is no closed form. Events are shuffled by account, sorted
within partitions and folded as a stream: memory holds one account's few numbers, however many events it has, since which grant is
an order's first is worked out before. An account's own events stay one task's work. Event times are data; no clock is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page allowances, tiers and lease rules.
WEEK_ONE_PAGES, DAILY_PAGES, REQUEST_CAP = 20, 1, 10_000
TIER_PAGES = {"starter": 100, "pro": 500, "max": 2000}
TIER_CENTS = {"starter": 900, "pro": 1900, "max": 4900}
OFFLINE_CAP, LEASE = 10, timedelta(minutes=24 * 60)

EVENT = "account string, ts timestamp, seq long, kind string, pages long, order_id string, lease_issued_at timestamp, lease_used long"
RESULT = (
    "account string, ts timestamp, seq long, kind string, allow boolean, reason string, from_daily long, from_week1 long, from_prepaid long, "
    "daily_left long, week1_left long, prepaid_left long, lease_issued_at timestamp, lease_ceiling long, charged long, reconciled long"
)


def waterfall(pages: Column, daily: Column, week1: Column) -> list[Column]:
    """How a request is split: from the daily page, then from week one, the rest from prepaid."""
    d = F.least(daily, pages)
    w = F.least(week1, pages - d)
    return [d.alias("from_daily"), w.alias("from_week1"), (pages - d - w).alias("from_prepaid")]


def remaining(granted: Column, usage: Column, active: Column | None = None) -> Column:
    """max(0, granted - usage); 0 for missing and inactive buckets."""
    left = F.greatest(granted - usage, F.lit(0))
    left = F.when(granted.isNull() | usage.isNull(), F.lit(0)).otherwise(left)
    return left if active is None else F.when(active, left).otherwise(F.lit(0))


@dataclass
class Account:
    """One account's buckets and lease; steps change it in place."""

    week_end: datetime
    day_end: datetime
    daily_used: int = 0
    daily_granted: int = DAILY_PAGES
    week_used: int = 0
    prepaid_used: int = 0
    prepaid_granted: int | None = None
    lease: tuple[datetime, datetime, int] | None = None

    @staticmethod
    def opened(now: datetime) -> "Account":
        return Account(now + timedelta(days=7), _day(now) + timedelta(days=1))

    def refill(self, now: datetime) -> None:
        if now > self.day_end:
            self.daily_used, self.daily_granted, self.day_end = 0, DAILY_PAGES, _day(now) + timedelta(days=1)

    def left(self, now: datetime) -> tuple[int, int, int]:
        week = max(0, WEEK_ONE_PAGES - self.week_used) if now <= self.week_end else 0
        return max(0, self.daily_granted - self.daily_used), week, max(0, (self.prepaid_granted or 0) - self.prepaid_used)

    def drain(self, pages: int, now: datetime) -> tuple[int, int, int]:
        """Daily, then week one, then prepaid, which is not bounded here; without a prepaid bucket that part is forgiven."""
        daily, week, _ = self.left(now)
        d = min(daily, pages)
        w = min(week, pages - d)
        p = pages - d - w
        self.daily_used, self.week_used = self.daily_used + d, self.week_used + w
        if self.prepaid_granted is not None:
            self.prepaid_used += p
        return d, w, p

    def settle(self, issued: datetime | None, used: int | None, now: datetime) -> tuple[int, int]:
        """(charged, reconciled): offline use that is reported against the lease, or the penalty for not reporting."""
        if issued is not None and used is not None and used >= 0:
            if self.lease is None or _ms(self.lease[0]) != _ms(issued) or now > self.lease[1] or used == 0:
                return 0, 0
            used = min(used, self.lease[2])
            self.refill(now)
            self.drain(used, now)
            return 0, used
        if self.lease is None or self.lease[2] <= 0:
            return 0, 0
        charged = self.lease[2]
        self.refill(now)
        self.drain(charged, now)
        self.lease = None
        return charged, 0

    def mint(self, now: datetime) -> None:
        """A new lease if there is none, it is over or half its time has passed."""
        if self.lease is None or now > self.lease[1] or now - self.lease[0] >= LEASE / 2:
            self.lease = (now, now + LEASE, max(0, min(sum(self.left(now)), OFFLINE_CAP)))

    def step(self, kind: str, now: datetime, pages: int | None, new: bool, issued: datetime | None, used: int | None) -> dict:
        out = {"allow": None, "reason": None, "from_daily": 0, "from_week1": 0, "from_prepaid": 0, "charged": 0, "reconciled": 0}
        if kind == "grant":
            out["allow"] = new
            if out["allow"]:
                self.prepaid_granted = (self.prepaid_granted or 0) + pages
            else:
                out["reason"] = "duplicate_order"
        elif kind == "consume" and not (pages and 0 < pages <= REQUEST_CAP):
            out["allow"], out["reason"] = False, "invalid_pages"
        elif kind in ("consume", "balance"):
            out["charged"], out["reconciled"] = self.settle(issued, used, now)
            self.refill(now)
            if kind == "balance":
                out["allow"] = True
                self.mint(now)
            elif sum(self.left(now)) < pages:
                out["allow"], out["reason"] = False, "insufficient_balance"
            else:
                out["allow"] = True
                out["from_daily"], out["from_week1"], out["from_prepaid"] = self.drain(pages, now)
        else:
            out["allow"], out["reason"] = False, "unknown_kind"
        daily, week, prepaid = self.left(now)
        lease = self.lease or (None, None, None)
        return out | {"daily_left": daily, "week1_left": week, "prepaid_left": prepaid, "lease_issued_at": lease[0], "lease_ceiling": lease[2]}


def _day(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _ms(t: datetime) -> int:
    return int(t.timestamp() * 1000)


def _none(x):
    return None if x is None or x is pd.NaT or x != x else x


def replay(events: DataFrame) -> DataFrame:
    """RESULT rows for EVENT rows: kinds grant, consume and balance, folded by account in the order of (ts, seq).

    An account opens at its first event. A grant whose order is missing or known does nothing. Null pages are invalid. Events
    without an account are dropped.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            rows = []
            for e in b.itertuples(index=False):
                now = e.ts.to_pydatetime()
                if e.account != name or state is None:
                    name, state = e.account, Account.opened(now)
                pages, used, issued = _none(e.pages), _none(e.lease_used), _none(e.lease_issued_at)
                got = state.step(e.kind, now, None if pages is None else int(pages), bool(e.new), issued.to_pydatetime() if issued is not None else None, None if used is None else int(used))
                rows.append({"account": e.account, "ts": e.ts, "seq": e.seq, "kind": e.kind} | got)
            if rows:
                out = pd.DataFrame(rows, columns=names)
                out["lease_issued_at"] = pd.to_datetime(out["lease_issued_at"])
                out["lease_ceiling"] = out["lease_ceiling"].astype("Int64")
                yield out

    fields = [f.strip().split(" ")[0] for f in EVENT.split(",")]
    rows = events.select(*fields).where("account is not null")
    granting = F.expr("kind = 'grant' and order_id <> '' and pages <> 0")
    first = F.row_number().over(Window.partitionBy("account", "order_id").orderBy("ts", "seq")) == 1
    rows = rows.where(granting).withColumn("new", first).unionByName(rows.where(~F.coalesce(granting, F.lit(False))).withColumn("new", F.lit(False)))
    ordered = rows.repartition(F.col("account")).sortWithinPartitions("account", "ts", "seq")
    return ordered.mapInPandas(run, RESULT)


# Client side


def offline_consume(requests: DataFrame) -> DataFrame:
    """(client, seq, allow, reason, used_before) for clients that spend their leases while offline.

    requests: client, seq, now, pages, expires_at, ceiling, used (offline use before a client's first request). Once a lease is over all is
    refused; a request that does not fit is refused and later ones may fit, so it is a fold, streamed over the requests in order:
    memory holds one client's number.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, used = None, 0
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.client != client:
                    client, used = r.client, int(r.used)
                over, ceiling = _none(r.expires_at), _none(r.ceiling)
                reason = "offline_state_missing" if ceiling is None else "offline_lease_expired" if over is None or r.now >= over else "offline_ceiling_reached" if r.pages > ceiling - used else None
                rows.append((r.client, r.seq, reason is None, reason, used))
                used += 0 if reason else int(r.pages)
            yield pd.DataFrame(rows, columns=["client", "seq", "allow", "reason", "used_before"])

    kept = requests.where("client is not null").select("client", F.col("seq").cast("long").alias("seq"), "now", "pages", "expires_at", "ceiling", "used")
    return kept.repartition(F.col("client")).sortWithinPartitions("client", "seq").mapInPandas(run, "client string, seq long, allow boolean, reason string, used_before long")


def overlay(states: DataFrame) -> DataFrame:
    """Each bucket's usage as the client shows it: offline use spread over the snapshot, daily, active week one, prepaid.

    states: client, now, offline_used, daily_usage, daily_granted, week1_usage, week1_granted, week1_expires_at, prepaid_usage, prepaid_granted.
    """
    c, o = F.col, F.col("offline_used")
    daily = F.least(remaining(c("daily_granted"), c("daily_usage")), o)
    week = F.least(remaining(c("week1_granted"), c("week1_usage"), F.coalesce(c("week1_expires_at") > c("now"), F.lit(False))), o - daily)
    prepaid = F.least(remaining(c("prepaid_granted"), c("prepaid_usage")), o - daily - week)
    return states.select("client", (c("daily_usage") + daily).alias("daily_usage"), (c("week1_usage") + week).alias("week1_usage"), (c("prepaid_usage") + prepaid).alias("prepaid_usage"))


# Accounts, purchases and migrations


def resolve_accounts(requests: DataFrame, accounts: DataFrame, device) -> DataFrame:
    """requests with account_id and outcome: found by machine id, else by device id, else new if the device id is the derived one."""
    machine = accounts.groupBy("machine_id").agg(F.min("id").alias("by_machine"))
    devices = accounts.groupBy(F.col("device_id").alias("known_device")).agg(F.min("id").alias("by_device"))
    found = requests.join(machine, "machine_id", "left").join(devices, F.col("device_id") == F.col("known_device"), "left").drop("known_device")
    outcome = F.when(F.col("by_machine").isNotNull(), "machine").when(F.col("by_device").isNotNull(), "device").when(device(F.col("machine_id")) == F.col("device_id"), "created").otherwise("invalid_device")
    return found.withColumns({"account_id": F.coalesce("by_machine", "by_device"), "outcome": outcome}).drop("by_machine", "by_device")


def opened_accounts(resolved: DataFrame, now: Column) -> DataFrame:
    """(machine_id, kept_in, sku, usage, pages, period_start, period_end): what new accounts start with, two balances and two purchases each.

    resolved: resolve_accounts() rows. A machine that asks more than once opens one account. Week one runs for seven days from now,
    the daily page for the day of now; purchases have no period.
    """
    day = F.date_trunc("day", now)
    week = F.struct(F.lit("free_week1").alias("sku"), F.lit(WEEK_ONE_PAGES).cast("long").alias("pages"), now.alias("a"), F.timestamp_add("DAY", F.lit(7), now).alias("z"))
    daily = F.struct(F.lit("free_daily").alias("sku"), F.lit(DAILY_PAGES).cast("long").alias("pages"), day.alias("a"), F.timestamp_add("DAY", F.lit(1), day).alias("z"))
    seeds = resolved.where("outcome = 'created'").select("machine_id").distinct().select("machine_id", F.explode(F.array(week, daily)).alias("s"))
    seeds = seeds.select("machine_id", F.explode(F.array(F.lit("balances"), F.lit("purchases"))).alias("kept_in"), "s")
    held = F.col("kept_in") == "balances"
    return seeds.select("machine_id", "kept_in", "s.sku", F.when(held, F.lit(0).cast("long")).alias("usage"), "s.pages", F.when(held, F.col("s.a")).alias("period_start"), F.when(held, F.col("s.z")).alias("period_end"))


def relinked(resolved: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, machine_id, device_id) of accounts found under another id than before: they take the request's ids (of several, the least)."""
    was = accounts.select(F.col("id").alias("account_id"), F.col("machine_id").alias("was_machine"), F.col("device_id").alias("was_device"))
    asked = resolved.where("account_id is not null").groupBy("account_id").agg(F.min(F.struct("machine_id", "device_id")).alias("now"))
    both = asked.join(was, "account_id").where("now.machine_id <> was_machine or now.device_id <> was_device")
    return both.select("account_id", "now.machine_id", "now.device_id")


def paid_orders(events: DataFrame, products: DataFrame) -> DataFrame:
    """(order_id, account_id, tier, pages, amount_cents) of webhook events that grant: paid, with an account and a known product.

    events: seq, body (JSON). Of events with the same order id the first counts.
    """
    shape = "type string, data struct<id: string, metadata: struct<account_id: string, tier: string>, productId: string, product_id: string, totalAmount: long, total_amount: long>"
    e = events.select("seq", F.from_json("body", shape).alias("e")).where("e.type = 'order.paid' and e.data.id <> ''")
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    rows = e.where(F.col("e.data.metadata.account_id").rlike(uuid)).select("seq", F.col("e.data.id").alias("order_id"), F.col("e.data.metadata.account_id").alias("account_id"), F.coalesce("e.data.productId", "e.data.product_id").alias("product_id"), F.coalesce("e.data.totalAmount", "e.data.total_amount", F.lit(0)).alias("amount_cents"))
    known = rows.join(products, "product_id")
    first = known.groupBy("order_id").agg(F.min(F.struct("seq", "account_id", "tier", "pages", "amount_cents")).alias("f"))
    return first.select("order_id", "f.account_id", "f.tier", "f.pages", "f.amount_cents")


def grant(balances: DataFrame, orders: DataFrame, done: DataFrame) -> DataFrame:
    """(account_id, granted): balances with the pages of orders not yet done."""
    new = orders.join(done.select("order_id"), "order_id", "left_anti").groupBy("account_id").agg(F.sum("pages").alias("granted"))
    return balances.select("account_id", "granted").unionByName(new).groupBy("account_id").agg(F.sum("granted").alias("granted"))


def newest(purchases: DataFrame, most: int = 10) -> DataFrame:
    """Each account's newest purchases, by time and then id."""
    order = Window.partitionBy("account_id").orderBy(F.desc("created_at"), F.desc("id"))
    return purchases.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def pending_migrations(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migration files (.sql) that were not applied, in order of name."""
    return files.where(F.col("filename").endswith(".sql")).join(applied.select("filename"), "filename", "left_anti").orderBy("filename")


def penalty_notices(penalties: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Penalties to show: charged, and whose lease the client has not dismissed. One row for each client and lease."""
    new = penalties.where("charged > 0").join(dismissed.select("client", "lease_issued_at"), ["client", "lease_issued_at"], "left_anti")
    return new.groupBy("client", "lease_issued_at").agg(F.max("charged").alias("charged"))


def purchases_detected(before: DataFrame, polls: DataFrame) -> DataFrame:
    """(client, at): the first poll in which what is left of prepaid pages is more than before (nothing, if unknown)."""
    was = before.select("client", remaining(F.col("granted"), F.col("usage")).alias("was"))
    now = polls.select("client", "at", remaining(F.col("granted"), F.col("usage")).alias("left"))
    grown = now.join(was, "client", "left").where(F.col("left") > F.coalesce("was", F.lit(0)))
    return grown.groupBy("client").agg(F.min("at").alias("at"))
