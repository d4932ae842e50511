"""orderlens.plans"""
