"""Which proposed names may become entities of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import names as N
from paperloom.functions.text import trimmed

#: Roles, which identify nobody.
ROLES = """
tenant, landlord, lessee, lessor, buyer, seller, purchaser, customer, client, employer, employee, borrower, lender,
insured, insurer, company, corporation, party, parties, applicant, recipient, sender, user, account holder, cardholder,
member, patient, provider, contractor, subcontractor, owner, occupant, guarantor, witness, notary, agent, broker,
the undersigned, undersigned, vendor, supplier, bank, landlords, policyholder, policy holder, beneficiary, dependent,
subscriber, payee, payer, claimant, signatory, co-signer, cosigner, manager, administrator, trustee, executor, guardian,
operator, passenger, guest, resident, student, staff, team
"""
#: Endings that make a single word a role.
ROLE_ENDINGS = "holder, payer, payee, signer, writer"
#: The vocabulary of paperwork.
PAPERWORK = """
deposit, withdrawal, payment, transfer, refund, credit, debit, balance, invoice, receipt, statement, total, subtotal, tax,
fee, charge, adjustment, interest, premium, copay, deductible, rent, utility, utilities, supplies, service, services,
description, amount, date, quantity, price, notice, terms, agreement, contract, policy, account, reference, summary
"""
#: What stands before those who handled a document, in the order in which they are tried.
HANDLERS = """
notary, notarized by, sworn before, witness, witnessed by, recorded by, clerk, prepared by, drafted by, issued through,
title work by, title company, escrow, attested, certified by, on behalf of, agent for, care of, c/o
"""
#: Places that are too broad to be a subject.
REGIONS = """
usa, us, united states, united states of america, canada, mexico, uk, united kingdom, england, california, ca, new york, ny,
texas, tx, florida, fl, washington, wa, oregon, or, nevada, nv, arizona, az, illinois, il, massachusetts, ma,
san francisco, los angeles, new york city, chicago, seattle, berkeley, oakland, boston, austin, denver, miami
"""
#: Characters before a name in which a handler's part is looked for.
LEAD = 60


def listed(values: str) -> list[str]:
    return [v.strip() for v in values.split(",")]


def gated(docs: DataFrame, id: str, text: str = "text", names: str = "names") -> DataFrame:
    """id, name and refused: why a name of a text's `names` is no entity of it, or null. The first reason that holds counts;
    null names are too short, null texts empty. A text is lower-cased and normalized once, before its names part.

    A handler is the part, HANDLERS, in which the text introduces the first occurrence of the name."""
    t = F.coalesce(F.col(text), F.lit(""))
    once = docs.select(id, F.lower(t).alias("__low"), N.normalized(t).alias("__body"), F.col(names).alias("__names"))
    rows = once.select(id, "__low", "__body", F.explode("__names").alias("name"))
    bare = trimmed(F.coalesce("name", F.lit("")))
    rows = rows.withColumns({"__name": bare, "__plain": N.normalized(bare)})
    name, plain = F.col("__name"), F.col("__plain")
    ending = plain.rlike("(" + "|".join(listed(ROLE_ENDINGS)) + ")$")
    word = (
        F.when(F.length(plain) < 2, "too short")
        .when(~name.rlike(r"\p{L}"), "no letters")
        .when(plain.rlike(r"^[\p{N}\s]*$"), "just a number")
        .when(plain.isin(listed(ROLES)), "generic role")
        .when(plain.isin(listed(PAPERWORK)), "paperwork term")
        .when(~F.contains(plain, F.lit(" ")) & ending & (F.length(plain) > 5), "generic role")
    )
    # Columns of their own, so that each is worked out once; the text is searched only for names that are left.
    rows = rows.withColumn("__word", word)
    rows = rows.withColumn("__at", F.when(F.col("__word").isNull(), F.instr("__low", F.lower(name))))
    begin = F.greatest(F.col("__at") - LEAD, F.lit(1))
    rows = rows.withColumn("__lead", F.when(F.col("__at") > 1, F.substring("__low", begin, F.col("__at") - begin)))
    role = F.coalesce(*(F.when(F.contains(F.col("__lead"), F.lit(h)), h) for h in listed(HANDLERS)))
    seen = (
        F.when(role.isNotNull(), F.concat(F.lit("named as the "), role))
        .when(plain.isin(listed(REGIONS)), "too broad a place")
        .when(~F.contains(F.col("__body"), plain), "not in the document")
    )
    return rows.select(id, "name", F.when(F.col("__word").isNotNull(), F.col("__word")).otherwise(seen).alias("refused"))
