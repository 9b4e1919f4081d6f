"""chatlake: chat-assistant analytics on Spark."""
