"""Every registered query once more as plain SQL over the test tables, for DuckDB.

Shop tables are common table expressions; a query names the ones it reads and
``sql`` puts them, and what they need, in front.
"""

import re

from tillbook.operators.posting import EXPENSE_NOTE, PURCHASE_NOTE

M = "decimal(18,4)"
T = "decimal(28,4)"
C = "decimal(28,6)"

TABLES = {
    "users": "select cast(n_nationkey as bigint) userID, n_name userName, n_name fullName from nation",
    "shelfs": "select cast(r_regionkey + 1 as bigint) shelfID, r_name shelfName from region",
    "categories": """select cast(id as bigint) categoryID, categoryName from (values (1, 'ECONOMY'),
        (2, 'LARGE'), (3, 'MEDIUM'), (4, 'PROMO'), (5, 'SMALL'), (6, 'STANDARD')) v(id, categoryName)""",
    "brands": """select distinct cast(substr(p_brand, 7) as bigint) brandID, p_brand brandName
        from part""",
    "units": """select cast(id as bigint) unitID, unitName from (values (1, 'piece'), (2, 'box'),
        (3, 'kg'), (4, 'pack')) v(id, unitName)""",
    "type_expense": """select cast(id as bigint) typeExpenseID, typeName from (values (1, 'rent'),
        (2, 'power'), (3, 'wages'), (4, 'other')) v(id, typeName)""",
    "priced": f"""select *, cast(cast(p_retailprice as decimal(12,2)) as {M}) retail,
        cast(cast(p_retailprice as decimal(12,2)) * cast(0.95 as decimal(4,2)) as {M}) cost
        from part""",
    "items": f"""select p_partkey itemID, concat('P', p_partkey) itemCode,
        concat(p_name, ' ', p_partkey) itemName,
        case when p_partkey % 19 = 0 then null else categoryID end categoryID,
        case when p_partkey % 17 = 0 then null else cast(substr(p_brand, 7) as bigint) end brandID,
        p_partkey % 5 + 1 shelfID, p_partkey % 4 + 1 unitID, p_size perUnit, cost costPrice,
        retail itemPriceRetail,
        cast(cast(p_retailprice as decimal(12,2)) * cast(0.9 as decimal(4,2)) as {M}) itemPriceWhole,
        p_size * 4 stockAlert, case when p_partkey % 20 = 1 then '0' else '1' end hideInStock,
        case when p_partkey % 10 = 3 then '1' else '0' end showButton, cast(null as varchar) note,
        case when p_partkey % 50 = 0 then '0' else '1' end deleteStatus, p_partkey % 25 userIDCreated
        from priced left join categories on categoryName = p_type""",
    "customers": f"""select c_custkey + 1 customerID, concat('Party', right(c_name, 9)) customerName,
        concat('07', c_custkey) phoneNumber, c_mktsegment address,
        cast(greatest(cast(c_acctbal as decimal(12,2)), 0) as {M}) previousDebt,
        cast(0 as {M}) limitDebt, '0' wholePrice,
        case when c_custkey % 25 = 0 then '1' else '0' end doesSupplier,
        case when c_custkey % 10 = 9 then '0' else '1' end activeStatus,
        cast(c_nationkey as bigint) userID, timestamp '1995-01-01 00:00:00' createAt from customer""",
    "suppliers": f"""select s_suppkey + 1 supplierID, concat('Party', right(s_name, 9)) supplierName,
        concat('08', s_suppkey) phone, cast(null as varchar) address,
        cast(greatest(cast(s_acctbal as decimal(12,2)), 0) as {M}) previousBalance,
        case when s_suppkey % 10 = 9 then '0' else '1' end activeStatus,
        cast(s_nationkey as bigint) userID, timestamp '1995-01-01 00:00:00' createAt from supplier""",
    "invoices": f"""select o_orderkey invoiceID, o_custkey + 1 customerID, o_orderkey % 25 userID,
        cast(o_totalprice as decimal(12,2))::{M} totalPrice,
        cast(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(12,2))
            when o_orderstatus = 'P' and o_orderkey % 11 = 0
                then cast(o_totalprice as decimal(12,2)) * cast(1.1 as decimal(4,2))
            when o_orderstatus = 'P'
                then cast(o_totalprice as decimal(12,2)) * cast(0.5 as decimal(4,2))
            else 0 end as {M}) initialPay,
        cast(0 as {M}) totalPay,
        cast(case when o_orderkey % 6 = 0 then 50000 else 0 end as decimal(18,2)) totalPayIQD,
        cast(cast(o_totalprice as decimal(12,2)) * cast(0.01 as decimal(4,2)) as {M}) discount,
        cast(1000 as decimal(12,4)) dollarPrice,
        case when o_orderpriority = '5-LOW' then 'rs' else 's' end stockType,
        case when o_orderstatus = 'O' then '0' else '1' end sellStatus,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'd' else 'c' end invoiceType,
        cast(null as bigint) rdcID, case when o_orderstatus = 'F' then '1' else '0' end wasl,
        (o_orderkey + 7) % 25 userIDUpdate, o_orderdate createAt from orders""",
    "sale_lines": """select l_orderkey, l_partkey, sum(cast(l_quantity as int))::int qty,
        min(l_discount) l_discount from lineitem where l_returnflag in ('N', 'R') group by all""",
    "invoice_item": f"""select l_orderkey * 1000000 + l_partkey invdID, l_orderkey invoiceID,
        l_partkey itemID, qty,
        cast(cast(p_retailprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as {M})
            productPrice,
        cost costPrice, l_partkey % 5 + 1 shelfID, l_partkey % 4 + 1 unitID,
        case when l_partkey % 7 = 0 then date '2000-01-01' + p_size end expiryDate
        from sale_lines join priced on l_partkey = p_partkey""",
    "disposal_lines": """select l_orderkey, l_partkey, sum(cast(l_quantity as int))::int qty
        from lineitem where l_returnflag = 'A' and l_linestatus = 'O' and l_tax < 0.015 group by all""",
    "disposals": """select l_orderkey * 1000000 + l_partkey disposalID, l_partkey itemID,
        cost costPrice, qty, cast(null as date) expiryDate,
        case when l_partkey % 3 = 0 then l_partkey % 25 else l_orderkey % 25 end userID,
        o_orderdate createAt
        from disposal_lines join orders on l_orderkey = o_orderkey join priced on l_partkey = p_partkey""",
    "purchase_items": f"""select (l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey pItemID,
        l_orderkey * 100000 + l_suppkey purchaseID, l_orderkey, l_suppkey, l_partkey itemID,
        min(cost) costPrice, sum(cast(l_quantity as int))::int qty, cast(0 as {M}) discount,
        min(cost) costAfterDisc
        from lineitem join priced on l_partkey = p_partkey
        where l_returnflag = 'A' and not (l_linestatus = 'O' and l_tax < 0.015)
        group by l_orderkey, l_suppkey, l_partkey""",
    "purchase_sums": f"""select purchaseID, l_orderkey, l_suppkey, cast(sum(qty * costPrice) as {M}) totalPrice
        from purchase_items group by all""",
    "purchases": f"""select purchaseID, l_suppkey + 1 supplierID,
        concat('REF', purchaseID % 1000) referenceNo,
        cast(case when purchaseID % 7 = 0 then 0 else 1000 end as decimal(12,4)) dollarPrice, totalPrice,
        cast(case when l_suppkey % 3 = 0 then totalPrice
            when l_suppkey % 3 = 1 then totalPrice * cast(0.5 as decimal(4,2)) else 0 end as {M}) amountPay,
        cast(case when purchaseID % 5 = 0 then 250000 else 0 end as decimal(18,2)) amountPayIQD,
        cast(0 as {M}) discount,
        case when l_orderkey % 2 = 0 then 'received' else 'pending' end PurchaseStatus,
        case when l_suppkey % 3 = 0 then 'c' else 'd' end paymentType, '0' debtStatus,
        case when l_suppkey % 10 = 0 then 'rp' else 'p' end stockType, cast(null as varchar) note,
        l_orderkey % 25 userIDCreated, (l_orderkey + 7) % 25 userIDUpdate, o_orderdate createAt
        from purchase_sums join orders on l_orderkey = o_orderkey""",
    "sales_stock": f"""select invoiceID sourceID, stockType sourceType, itemID,
        (case when stockType = 's' then -qty else qty end)::int qty, productPrice itemPrice, costPrice,
        case when stockType <> 's' then expiryDate end expiryDate, createAt
        from invoice_item join invoices using (invoiceID) where sellStatus = '1'""",
    "purchase_stock": f"""select purchaseID sourceID, stockType sourceType, itemID,
        (case when stockType = 'p' then qty else -qty end)::int qty, cast(0 as {M}) itemPrice, costPrice,
        cast(null as date) expiryDate, createAt from purchase_items join purchases using (purchaseID)""",
    "disposal_stock": f"""select disposalID sourceID, 'd' sourceType, itemID, (-qty)::int qty,
        cast(0 as {M}) itemPrice, costPrice, expiryDate, createAt from disposals""",
    "stock": """select * from sales_stock union all select * from purchase_stock
        union all select * from disposal_stock""",
    "gains": """select *, itemPrice - costPrice margin, -(qty * (itemPrice - costPrice)) gain
        from stock""",
    "valued": f"""select *, cast(cast(value as decimal(12,2)) as {M}) amount from events""",
    "return_debt_customer": f"""select event_id rdcID, user_id + 2 customerID, event_id % 5 + 1 shelfID,
        cast(amount * 500 as {M}) amountReturn, cast(0 as decimal(18,2)) amountReturnIQD,
        cast(case when event_id % 4 = 0 then amount * 10 else 0 end as {M}) discount,
        cast(1000 as decimal(12,4)) dollarPrice,
        case when event_id % 6 = 0 then null else concat(user_id, ',', user_id + 1) end invoiceNumbers,
        user_id % 25 userID, ts createAt from valued where event_type = 'purchase'""",
    "return_debt": f"""select event_id rdID, user_id % 10 + 1 supplierID, event_id % 5 + 1 shelfID,
        amount amountReturn, cast(0 as decimal(18,2)) amountReturnIQD, cast(null as varchar) referenceNO,
        cast(case when event_id % 4 = 0 then amount * cast(0.1 as decimal(4,2)) else 0 end as {M}) discount,
        cast(1000 as decimal(12,4)) dollarPrice,
        case when event_id % 3 <> 0 then null
            else array_to_string([event_id * 100000 + k for k in range(20)], ',') end purchaseNumbers,
        user_id % 25 userID, ts createAt from valued where event_type = 'signup'""",
    "expenses": f"""select event_id expenseID, event_id % 4 + 1 typeExpenseID, event_id % 5 + 1 shelfID,
        cast(case when event_id % 2 = 0 then amount * 1000 else 0 end as decimal(18,2)) priceExpenseIQD,
        cast(case when event_id % 2 = 1 then amount else 0 end as {M}) priceExpenseUSD,
        cast(case when event_id % 7 = 0 then 0 when event_id % 2 = 0 then 1250 else 1000 end
            as decimal(12,4)) dollarPrice,
        case when event_id % 3 = 0 then concat('note ', event_id) end note, user_id % 25 userIDCreated,
        ts createAt from valued where event_type = 'error'""",
    "box_transaction": f"""select event_id btID, event_id % 5 + 1 shelfID, event_id sourceID,
        cast(case when event_id % 3 = 0 then amount else -amount end as {M}) amount,
        cast(case when event_id % 3 = 1 then -amount else amount end * 1000 as decimal(18,2)) amountIQD,
        case when event_id % 3 = 0 then 'in' when event_id % 3 = 1 then 'out' else 'ex' end "type",
        cast(null as varchar) note, user_id % 25 userID, ts createAt
        from valued where event_type = 'click'""",
    "money_box": """select event_id mbID, event_id % 5 + 1 shelfID,
        (event_id + 1 + user_id % 4) % 5 + 1 shelfID2, amount, user_id % 25 userID, ts createAt
        from valued where event_type = 'view'""",
    "discounts": f"""select p_partkey * 2 + k dID, p_partkey itemID, retail itemPriceRetail,
        cast(retail * cast(0.1 * (k + 1) as decimal(4,2)) as {M}) discount,
        cast(retail * (1 - cast(0.1 * (k + 1) as decimal(4,2))) as {M}) priceAfterDiscount,
        date '1997-01-01' + p_size + 15 * k - 5 createDate, date '1997-01-01' + p_size + 15 * k startDate,
        date '1997-01-01' + p_size + 15 * k + 30 endDate, p_partkey % 25 userID
        from priced join (values (0), (1)) v(k) on true where p_type = 'PROMO'""",
    "sales_account": f"""select invoiceID sourceID, stockType sourceType, customerID accountID,
        'c' accountType, customerName accountName,
        cast(case when stockType = 's' then -totalPrice else totalPrice end as {M}) totalPrice,
        cast(case when stockType <> 's' then 0 when initialPay <= 0 and totalPayIQD > 0
            then totalPayIQD * cast(0.001 as decimal(4,3))
            else initialPay + totalPayIQD * cast(0.001 as decimal(4,3)) end as {C}) totalPay,
        totalPayIQD, invoiceType transactionType, userIDUpdate userID, invoices.createAt
        from invoices join customers using (customerID) where sellStatus = '1' and customerID <> 1""",
    "purchase_paid": f"""select *, cast(case when amountPayIQD = 0 then amountPay when dollarPrice = 0 and amountPay <= 0 then 0
        when dollarPrice = 0 then amountPay when amountPay <= 0 then amountPayIQD * cast(0.001 as decimal(4,3))
        else amountPay + amountPayIQD * cast(0.001 as decimal(4,3)) end as {C}) paid from purchases""",
    "purchase_account": f"""select purchaseID sourceID, stockType sourceType, supplierID accountID,
        's' accountType, supplierName accountName,
        cast(case when stockType = 'p' then totalPrice else -totalPrice end as {M}) totalPrice,
        cast(case when stockType = 'p' then paid else 0 end as {C}) totalPay,
        amountPayIQD totalPayIQD, paymentType transactionType, userIDCreated userID,
        purchase_paid.createAt from purchase_paid join suppliers using (supplierID)""",
    "opening": f"""select customerID sourceID, 'pdc' sourceType, customerID accountID, 'c' accountType,
        customerName accountName, cast(-previousDebt as {M}) totalPrice, cast(0 as {C}) totalPay,
        cast(0 as decimal(18,2)) totalPayIQD, 'd' transactionType, userID, createAt from customers
        union all select supplierID, 'pds', supplierID, 's', supplierName, previousBalance,
        cast(0 as {C}), cast(0 as decimal(18,2)), 'd', userID, createAt from suppliers""",
    "repayment_account": f"""select rdID sourceID, 'rdp' sourceType, supplierID accountID, 's' accountType,
        supplierName accountName, cast(-amountReturn as {M}) totalPrice, cast(0 as {C}) totalPay,
        cast(0 as decimal(18,2)) totalPayIQD, 'rd' transactionType, return_debt.userID,
        return_debt.createAt from return_debt left join suppliers using (supplierID)""",
    "sales_box": f"""select cast(1 as bigint) shelfID, invoiceID sourceID,
        cast(case when stockType = 's' then initialPay else -initialPay end as {M}) amount,
        cast(case when stockType = 's' then totalPayIQD else -totalPayIQD end as decimal(18,2)) amountIQD,
        stockType "type", case when stockType = 's' then concat_ws(' ', '', customerName, '',
            invoiceID) else concat_ws(' ', '', customerName) end note,
        userIDUpdate userID, invoices.createAt
        from invoices left join customers using (customerID) where sellStatus = '1'""",
    "purchase_box": f"""select cast(1 as bigint) shelfID, purchaseID sourceID,
        cast(case when stockType = 'p' then -amountPay else amountPay end as {M}) amount,
        cast(case when stockType = 'p' then -amountPayIQD else amountPayIQD end as decimal(18,2)) amountIQD,
        stockType "type", concat('{PURCHASE_NOTE} ', referenceNo) note, userIDCreated userID,
        createAt from purchases""",
    "repayment_box": f"""select shelfID, rdID sourceID, cast(-(amountReturn + discount) as {M}) amount,
        cast(-amountReturnIQD as decimal(18,2)) amountIQD, 'rdp' "type",
        supplierName note, r.userID, r.createAt
        from return_debt r left join suppliers using (supplierID)""",
    "customer_repayment_account": f"""select rdcID sourceID, 'rds' sourceType, customerID accountID,
        'c' accountType, customerName accountName, cast(amountReturn - discount as {M}) totalPrice,
        cast(0 as {C}) totalPay, cast(0 as decimal(18,2)) totalPayIQD, 'rd' transactionType,
        return_debt_customer.userID, return_debt_customer.createAt
        from return_debt_customer left join customers using (customerID) where customerID <> 1""",
    "customer_repayment_box": f"""select shelfID, rdcID sourceID, cast(amountReturn as {M}) amount,
        cast(amountReturnIQD as decimal(18,2)) amountIQD, 'rds' "type", coalesce(customerName, '') note,
        return_debt_customer.userID, return_debt_customer.createAt
        from return_debt_customer left join customers using (customerID)""",
    "expense_box": f"""select shelfID, expenseID sourceID, cast(-priceExpenseUSD as {M}) amount,
        cast(-priceExpenseIQD as decimal(18,2)) amountIQD, 'exp' "type",
        coalesce(note, '{EXPENSE_NOTE}') note, userIDCreated userID, createAt from expenses""",
    "box": """select * replace (trim(note) as note) from sales_box union all select * from purchase_box
        union all select * from repayment_box union all select * from expense_box
        union all select * exclude (btID) from box_transaction""",
    "transactions": """select * from sales_account union all select * from purchase_account
        union all select * from opening union all select * from repayment_account""",
    "customer_accounts": f"""select customerID, customerName, previousDebt,
        cast(coalesce(sum(totalPrice) filter (stockType = 's' and invoiceType = 'd'), 0) as {T})
            totalInvoiceDebt,
        cast(coalesce(sum(initialPay + totalPayIQD * cast(0.001 as decimal(4,3)))
            filter (stockType = 's' and invoiceType = 'd'), 0) as {C}) totalPay,
        cast(coalesce(sum(totalPrice) filter (stockType = 'rs'), 0) as {T}) totalReturnInvoice
        from customers left join (select * exclude (userID, createAt) from invoices where sellStatus = '1') using (customerID)
        group by customerID, customerName, previousDebt""",
    "supplier_accounts": f"""select supplierID, supplierName, previousBalance,
        cast(coalesce(sum(totalPrice) filter (stockType = 'p' and paymentType = 'd'), 0) as {T})
            totalPurchaseDebt,
        cast(coalesce(sum(paid) filter (stockType = 'p' and paymentType = 'd'), 0) as {C}) totalPay,
        cast(coalesce(sum(totalPrice) filter (stockType = 'rp'), 0) as {T}) totalReturnPurchase
        from suppliers left join (select * exclude (createAt) from purchase_paid) using (supplierID)
        group by supplierID, supplierName, previousBalance""",
    "customer_repaid": f"""select customerID, cast(sum(amountReturn) as {T}) totalReturnDebt
        from return_debt_customer group by customerID""",
    "supplier_repaid": f"""select supplierID, cast(sum(amountReturn) as {T}) totalReturnDebt
        from return_debt group by supplierID""",
    "customer_remains": f"""select * replace (cast(coalesce(totalReturnDebt, 0) as {T}) as totalReturnDebt),
        cast(previousDebt + totalInvoiceDebt
            - (totalReturnInvoice + totalPay + coalesce(totalReturnDebt, 0)) as {C}) totalRemainCustomer
        from customer_accounts left join customer_repaid using (customerID)""",
    "supplier_remains": f"""select *, cast(previousBalance + totalPurchaseDebt
            - (totalPay + totalReturnPurchase + coalesce(totalReturnDebt, 0)) as {C}) totalRemainSupplier
        from supplier_accounts left join supplier_repaid using (supplierID)""",
    "unpaid": f"""select invoiceID, customerID, createAt, totalPay,
        cast(totalPrice - (initialPay + totalPay) as {M}) total
        from invoices where wasl = '0' and stockType = 's'""",
    "listed": """select rdcID, customerID, createAt, cast(trim(id) as bigint) invoiceID
        from (select *, unnest(string_split(invoiceNumbers, ',')) id from return_debt_customer
              where invoiceNumbers is not null) where trim(id) <> ''""",
    "moves": """select event_id, ts, user_id itemID,
        case event_type when 'click' then 's' when 'purchase' then 'rs' when 'signup' then 'p'
            when 'view' then 'rp' else 'd' end sourceType,
        cast(ceil(cast(value as decimal(12,2))) as int)
            * case when event_type in ('purchase', 'signup') then 1 else -1 end qty,
        amount from valued""",
}

_READS = re.compile(r"\b(?:from|join)\s+(\w+)", re.IGNORECASE)


def _needs(text: str, found: dict[str, str]) -> None:
    for name in _READS.findall(text):
        if name in TABLES and name not in found:
            _needs(TABLES[name], found)
            found[name] = TABLES[name]


def sql(body: str, **extra: str) -> str:
    """A query with its tables in front; ``extra`` names further expressions of its own."""
    found: dict[str, str] = {}
    for text in (*extra.values(), body):
        _needs(text, found)
    found.update(extra)
    if not found:
        return body
    listed = ",\n".join(f"{name} as ({text})" for name, text in found.items())
    return f"with {listed}\n{body}"
