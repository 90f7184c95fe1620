from ledgerwatch.jobs import main

main()
