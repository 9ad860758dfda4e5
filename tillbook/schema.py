"""Declared table schemas and the code letters used in them.

Dollar amounts carry four decimals so that a price after a percentage discount
stays exact; eighteen digits keep a value in one machine word. Sums are widened
to ``TOTAL``. Nothing here is ever a floating point number.
"""

MONEY = "decimal(18,4)"
IQD = "decimal(18,2)"
RATE = "decimal(12,4)"
TOTAL = "decimal(28,4)"
IQD_TOTAL = "decimal(28,2)"
CONVERTED = "decimal(28,6)"

# Document and ledger codes.
SALE = "s"
SALE_RETURN = "rs"
PURCHASE = "p"
PURCHASE_RETURN = "rp"
DISPOSAL = "d"
OPENING_CUSTOMER = "pdc"
OPENING_SUPPLIER = "pds"
REPAY_SUPPLIER = "rdp"
REPAY_CUSTOMER = "rds"
EXPENSE = "exp"
CASH_IN = "in"
EXCHANGE = "ex"

CUSTOMER = "c"
SUPPLIER = "s"

CASH = "c"
DEBT = "d"
REPAYMENT = "rd"

YES = "1"
NO = "0"

WALK_IN = 1
# The row that holds the current rate.
CURRENT = 1
MAIN_SHELF = 1

TABLES = {
    "users": "userID bigint, userName string, fullName string",
    "shelfs": "shelfID bigint, shelfName string",
    "categories": "categoryID bigint, categoryName string",
    "brands": "brandID bigint, brandName string",
    "units": "unitID bigint, unitName string",
    "items": f"""itemID bigint, itemCode string, itemName string, categoryID bigint, brandID bigint,
        shelfID bigint, unitID bigint, perUnit int, costPrice {MONEY}, itemPriceRetail {MONEY},
        itemPriceWhole {MONEY}, stockAlert int, hideInStock string, showButton string, note string,
        deleteStatus string, userIDCreated bigint""",
    "customers": f"""customerID bigint, customerName string, phoneNumber string, address string,
        previousDebt {MONEY}, limitDebt {MONEY}, wholePrice string, doesSupplier string,
        activeStatus string, userID bigint, createAt timestamp_ntz""",
    "suppliers": f"""supplierID bigint, supplierName string, phone string, address string,
        previousBalance {MONEY}, activeStatus string, userID bigint, createAt timestamp_ntz""",
    "invoices": f"""invoiceID bigint, customerID bigint, userID bigint, totalPrice {MONEY},
        initialPay {MONEY}, totalPay {MONEY}, totalPayIQD {IQD}, discount {MONEY}, dollarPrice {RATE},
        stockType string, sellStatus string, invoiceType string, rdcID bigint, wasl string,
        userIDUpdate bigint, createAt timestamp_ntz""",
    "invoice_item": f"""invdID bigint, invoiceID bigint, itemID bigint, qty int, productPrice {MONEY},
        costPrice {MONEY}, shelfID bigint, unitID bigint, expiryDate date""",
    "purchases": f"""purchaseID bigint, supplierID bigint, referenceNo string, dollarPrice {RATE},
        totalPrice {MONEY}, amountPay {MONEY}, amountPayIQD {IQD}, discount {MONEY},
        PurchaseStatus string, paymentType string, debtStatus string, stockType string, note string,
        userIDCreated bigint, userIDUpdate bigint, createAt timestamp_ntz""",
    "purchase_items": f"""pItemID bigint, purchaseID bigint, itemID bigint, costPrice {MONEY}, qty int,
        discount {MONEY}, costAfterDisc {MONEY}""",
    "disposals": f"""disposalID bigint, itemID bigint, costPrice {MONEY}, qty int, expiryDate date,
        userID bigint, createAt timestamp_ntz""",
    "stock": f"""sourceID bigint, sourceType string, itemID bigint, qty int, itemPrice {MONEY},
        costPrice {MONEY}, expiryDate date, createAt timestamp_ntz""",
    "transactions": f"""sourceID bigint, sourceType string, accountID bigint, accountType string,
        accountName string, totalPrice {MONEY}, totalPay {CONVERTED}, totalPayIQD {IQD},
        transactionType string, userID bigint, createAt timestamp_ntz""",
    "box_transaction": f"""btID bigint, shelfID bigint, sourceID bigint, amount {MONEY},
        amountIQD {IQD}, type string, note string, userID bigint, createAt timestamp_ntz""",
    "cash_entries": f"""btID bigint, shelfID bigint, sourceID bigint, amount {MONEY},
        amountIQD {IQD}, type string, note string, userID bigint, createAt timestamp_ntz""",
    "return_debt_customer": f"""rdcID bigint, customerID bigint, shelfID bigint, amountReturn {MONEY},
        amountReturnIQD {IQD}, discount {MONEY}, dollarPrice {RATE}, invoiceNumbers string,
        userID bigint, createAt timestamp_ntz""",
    "return_debt": f"""rdID bigint, supplierID bigint, shelfID bigint, amountReturn {MONEY},
        amountReturnIQD {IQD}, referenceNO string, discount {MONEY}, dollarPrice {RATE},
        purchaseNumbers string, userID bigint, createAt timestamp_ntz""",
    "expenses": f"""expenseID bigint, typeExpenseID bigint, shelfID bigint, priceExpenseIQD {IQD},
        priceExpenseUSD {MONEY}, dollarPrice {RATE}, note string, userIDCreated bigint,
        createAt timestamp_ntz""",
    "dollar": f"dollarId bigint, dollarPrice {RATE}",
    "type_expense": "typeExpenseID bigint, typeName string",
    "money_box": f"""mbID bigint, shelfID bigint, shelfID2 bigint, amount {MONEY}, userID bigint,
        createAt timestamp_ntz""",
    "discounts": f"""dID bigint, itemID bigint, itemPriceRetail {MONEY}, discount {MONEY},
        priceAfterDiscount {MONEY}, createDate date, startDate date, endDate date, userID bigint""",
}
