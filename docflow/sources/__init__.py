"""Sources and the providers that stand behind them."""
