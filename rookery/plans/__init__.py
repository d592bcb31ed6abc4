"""rookery.plans"""
